"""The entry module imports without a session and without the llm subpackage."""

import os
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_import_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'cls_rule_hits' in q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True)


def test_import_without_llm():
    code = "import sys; sys.modules['rulespark.llm'] = None; import __spark_entry__ as e; assert 'cls_rule_hits' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=TOP, check=True)

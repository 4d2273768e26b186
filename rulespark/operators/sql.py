"""The engines as SQL functions, under names of one's choice: classify(text), json_validate(json), json_convert(json), json_path(json).

Where an engine has a Column form, the function is one that SQL defines: `CREATE TEMPORARY FUNCTION name(x STRING) RETURNS type RETURN expression`.
Catalyst puts the expression in the query's place, so nothing leaves the JVM, and filters and columns are pushed through it. `register_hits`
is a table function for lateral joins. Rule sets beyond the Columns' size and functions of one's own run in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonpath import columns, parse_path
from ..functions.outcome import bound
from ..functions.pattern import terms
from .classifier import NATIVE_TERMS, Classifier, Engine
from .converter import Converter
from .validator import ERRORS, Validator

OUTCOME = "STRUCT<ok: BOOLEAN, value: STRING, error: STRING>"
_TEXT = re.compile(r"('(?:\\.|[^'\\])*')", re.S)
_SIGN = re.compile(r"(?<![\w`])(<=>|<=|>=|!=|==|[=<>!+\-*/%&|^]|and|or|not)\(")


def sql_text(c: Column) -> str:
    """A Column as SQL. Operators stand as functions there, whose names need quotes; in texts, ${ would be taken for a variable."""
    parts = _TEXT.split(c._jc.node().sql())
    return "".join(p.replace("${", r"\u0024{") if i % 2 else _SIGN.sub(r"`\1`(", p) for i, p in enumerate(parts))


def define(spark: SparkSession, name: str, returns: str, body: Callable[[Column], Column]) -> None:
    """A SQL function of one text."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {returns} RETURN {sql_text(body(F.col('x')))}")


def _parsed(use: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: bound(F.try_parse_json(x), use)


def _told(o: Column) -> Column:
    return bound(o, lambda s: F.struct(s["value"].isNotNull().alias("ok"), s["value"].alias("value"), s["error"].alias("error")))


def register_classifier(spark: SparkSession, name: str, classifier: Classifier) -> None:
    """name(text): the ids of the rules that hold."""
    if sum(1 for r in classifier.rules.values() for _ in terms(r)) <= NATIVE_TERMS * 16:
        define(spark, name, "ARRAY<INT>", lambda x: F.coalesce(classifier.ids(x), F.array().cast("array<int>")))
        return
    engine = Engine(classifier.rules, classifier.documented)

    @F.pandas_udf("array<int>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [h["rule_id"] for h in engine.search(t)] if t is not None else [])

    spark.udf.register(name, f)


def register_hits(spark: SparkSession, name: str, classifier: Classifier) -> None:
    """name(text), a table of (rule_id, rule) for the rules that hold: SELECT ... FROM t, LATERAL name(t.text)."""
    ids = sql_text(classifier.ids(F.col("x")))
    rules = F.create_map(*[x for i, r in classifier.rules.items() for x in (F.lit(i), F.lit(str(r)))]) if classifier.rules else F.create_map().cast("map<int,string>")
    rule = f"element_at({sql_text(rules)}, rule_id)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS TABLE(rule_id INT, rule STRING) RETURN SELECT rule_id, {rule} FROM (SELECT explode({ids}) AS rule_id)")


def register_validator(spark: SparkSession, name: str, validator: Validator) -> None:
    """name(json): ok, the pruned document and the error tree."""
    define(spark, name, OUTCOME, _parsed(lambda v: _told(validator.outcome(v))))


def register_checks(spark: SparkSession, name: str, validator: Validator) -> None:
    """name(json): the flat array of errors, empty where the rule holds."""
    define(spark, name, ERRORS, _parsed(validator.errors))


def register_converter(spark: SparkSession, name: str, converter: Converter) -> None:
    """name(json): ok, the result and the error tree."""
    if converter.outcome(F.col("x")) is not None:
        from ..functions.outcome import literal, outcome

        define(spark, name, OUTCOME, _parsed(lambda v: _told(F.when(v.isNull(), outcome(None, literal("not valid json"))).otherwise(converter.outcome(v)))))
        return

    @F.pandas_udf("ok boolean, value string, error string")
    def f(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([converter.convert(x) for x in s], columns=["ok", "value", "error"])

    spark.udf.register(name, f)


def register_path(spark: SparkSession, name: str, path: str) -> None:
    """name(json): the nodes of a path, as JSON texts."""
    tree = parse_path(path)
    none = F.array().cast("array<string>")
    define(spark, name, "ARRAY<STRING>", _parsed(lambda v: F.when(v.isNull(), none).otherwise(F.coalesce(F.transform(columns(tree, v), lambda n: F.to_json(n)), none))))

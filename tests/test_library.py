"""Navigation, strings, SQL functions, exact lookup, printed templates and paths."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulespark.functions import jsonpath, strings, values
from rulespark.functions.navigate import Node
from rulespark.operators import classifier, sql
from rulespark.operators.classifier import Classifier, exact_lookup
from rulespark.operators.converter import Converter, check_templates
from rulespark.operators.paths import printed_paths
from rulespark.operators.validator import Validator
from rulespark.plans.library import QUERIES

CRATE = '{"a":[{"b":1},[{"b":2},[{"b":[3]}]],{"c":4}],"s":"12","d":-1.5,"n":null,"t":true,"o":{"z":1,"y":2},"big":123456789012345678901,"e":"1e2","one":[{"b":7}],"huge":1e300,"none":[]}'


@pytest.fixture(scope="module")
def crate(spark):
    return spark.createDataFrame([(CRATE,)], "json string").select(F.parse_json("json").alias("v"))


def one(df, *cols):
    return tuple(df.select(*cols).first())


def test_routes(crate):
    root = Node(F.col("v"))
    routes = {("a", "b"): "[1,2,[3]]", ("a", "c"): "4", ("a", "q"): None, ("one", "b"): "7", ("o", "y"): "2", ("s", "x"): None, ("n",): "null", ("none", "b"): None, ("zip", "zap"): None, (): None}
    del routes[()]
    assert one(crate, *[F.to_json(root.route(*r).v) for r in routes]) == tuple(routes.values())
    got = one(crate, root.get("a", "q").error, F.to_json(root.get("o", "y").value), root.get("o", "y").error)
    assert got[0].startswith("not exist: a.q in {") and got[1:] == ("2", None)
    assert one(crate, *[F.size(root.field(k).as_list()) for k in ("a", "o", "none", "zip")]) == (3, 1, 0, 1)


def test_states(crate):
    root = Node(F.col("v"))
    for key, want in {"n": (False, True, False, True), "zip": (True, False, True, False), "s": (False, False, True, True)}.items():
        x = root.field(key)
        assert one(crate, x.is_nothing(), x.is_null(), x.not_null(), x.not_nothing()) == want
        assert one(crate, x.to_option().isNotNull()) == (want[3],)


def test_typed_access(crate):
    root = Node(F.col("v"))
    want = {
        "to_long": {"s": 12, "d": -1, "big": 123456789012345678901 - 7 * 2**64 + (0 if 123456789012345678901 - 7 * 2**64 < 2**63 else -(2**64)), "huge": 2**63 - 1, "e": None, "t": None, "n": None, "zip": None},
        "to_double": {"s": 12.0, "d": -1.5, "big": 1.2345678901234568e20, "huge": 1e300, "e": 100.0, "t": None, "o": None},
        "to_big_int": {"s": 12, "d": -1, "big": 123456789012345678901, "huge": 2**63 - 1, "e": None},
        "as_long": {"s": None, "d": None, "big": None}, "as_big_int": {"big": 123456789012345678901, "d": None}, "as_double": {"d": -1.5, "huge": 1e300, "big": None},
        "as_string": {"s": "12", "d": None, "n": None}, "as_boolean": {"t": True, "s": None},
    }
    for method, by_key in want.items():
        results = [getattr(root.field(k), method)() for k in by_key]
        got = one(crate, *[r.value for r in results], *[r.error.isNull() for r in results])
        assert [None if x is None else type(w)(x) if w is not None else x for x, w in zip(got, by_key.values(), strict=False)] == list(by_key.values()), method
        assert got[len(results) :] == tuple(w is not None for w in by_key.values())
    assert [str(x) for x in one(crate, root.field("d").to_decimal().value, root.field("e").to_decimal().value, root.field("d").as_decimal().value)] == ["-1.500000000000000000", "100.000000000000000000", "-1.500000000000000000"]
    assert one(crate, F.to_json(root.field("d").as_numeric().value), root.field("s").as_numeric().error, F.to_json(root.field("o").as_object().value), root.field("s").as_object().error, root.field("o").as_array().error) == ("-1.5", 'not Numeric : "12"', '{"y":2,"z":1}', 'not JObject : "12"', 'not JArray : {"y":2,"z":1}')
    assert [(e["key"], str(e["value"])) for e in one(crate, root.field("o").as_object_values().value)[0]] == [("y", "2"), ("z", "1")]
    assert one(crate, F.size(root.field("a").as_array_values().value), root.field("s").matches("^1"), root.field("d").matches(".")) == (3, True, False)


@pytest.mark.parametrize(
    "text, plain, whole",
    [
        (r"a\tb\\n\"\'", r"a\tb\\n\"\'", "a\tb\\n\"'"), (r"\uuu00e9A", "éA", "éA"), (r"😀!", "😀!", "😀!"), (r"\uD83Dx\uDE00", "�x�", "�x�"), (r"\q", r"\q", None), ("a\\", "a\\", None),
        (r"\n", r"\n", "\n"), (r"\u12", r"\u12", None), (r"\7", r"\7", None), ("", "", ""), ("plain", "plain", "plain"), (None, None, None), ("\\\\" * 3000 + "😀", "\\\\" * 3000 + "😀", "\\" * 3000 + "😀"),
    ],
)
def test_escapes(spark, text, plain, whole):
    df = spark.createDataFrame([(text,)], "s string")
    assert one(df, strings.unescape_unicode(F.col("s")), strings.unescape(F.col("s"))) == (plain, whole)


def test_interpolation(spark):
    df = spark.createDataFrame([("${a.b}-${c}-${zz}-$${a.b}${}", "${p[q]}|${p[r]}|${p}"), ("", ""), (None, None)], "t string, u string")
    out = df.select(strings.interpolate(F.col("t"), {"a.b": "${c}", "c": F.lit("$1\\")}), strings.interpolate_each("p", "q", F.array(F.lit("1$"), F.lit("\\2")), F.col("u")), strings.has_key(F.col("t"))).collect()
    assert [tuple(r) for r in out] == [("${c}-$1\\--$${c}${}", ["1$||${p}", "\\2||${p}"], True), ("", ["", ""], False), (None, [None, None], None)]


def test_exact_lookup(spark):
    """100,000 keywords and more; whole texts only, whatever their case; a hot text, repeated keywords, nulls and clashing names."""
    keys = spark.range(100_000).select(F.col("id"), F.concat(F.lit("Key Ü "), F.col("id").cast("string")).alias("keyword"))
    keys = keys.union(spark.createDataFrame([(-1, "KEY ü 7"), (-2, ""), (-3, None), (None, "no id")], "id long, keyword string"))
    rows = [(1, "key ü 7"), (2, "KEY Ü 99999"), (3, "key ü 7 "), (4, "xkey ü 7"), (5, ""), (6, None), (7, "No ID"), (8, "key ü " + "9" * 10_000), *[(9, "key ü 5")] * 500]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "id int, _own0 string, _key string")
    out = exact_lookup(df, "_own0", keys)
    assert out.columns == ["id", "_own0", "_key", "keyword_id"]
    got = [tuple(r) for r in out.collect()]
    assert {r[2] for r in got} == {"mine"}
    assert sorted({(r[0], r[3]) for r in got}, key=repr) == sorted([(1, 7), (1, -1), (2, 99999), (7, None), (9, 5)], key=repr) and len(got) == 504
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan and "CartesianProduct" not in plan
    assert exact_lookup(df, "_own0", keys.filter("false")).collect() == []


PRINTED = [
    "$", "@", "$.a['b','c'].'x y'..z..*[1:2][::2][0,3].*", "$.a[?(@.a == 'it\\'s' && (@.b =~ 'd\\\\.' || 1 <= @.c) || $.q[?(@.e)])]", "$..[?(@.x != empty)]..'a b'[?(@.y > -1.50 && @.z == null || @ == true)][?()]",
    "$.x::trim().replace('a\\'b','\\\\').toLongOr(-3)",
]


def test_printed_paths(spark):
    df = spark.createDataFrame(list(enumerate([*PRINTED, "$.", None])), "id int, p string")
    got = {r["id"]: r["printed"] for r in printed_paths(df, "p").collect()}
    assert got[len(PRINTED)] is None and got[len(PRINTED) + 1] is None
    for i, p in enumerate(PRINTED):
        assert jsonpath.parse_with_functions(got[i]) == jsonpath.parse_with_functions(p), got[i]


def test_printed_templates(spark):
    texts = [
        '{"{$$}": "$.a[?(@.b == \'q\')]", "{$>}": {"{::}": "$", "{=>}": {"x": "@.y::trim()"}, "l": {"[::]": "$.z[*]", "[=>]": {"k": "\\\\$x", "b": "\\\\\\\\y", "n": null, "f": 1.5}}}}',
        '{"[$$]": "$..b", "[$>]": {"u": "ü", "o": {"p": "$"}}}',
    ]
    for t in texts:
        c = Converter(t)
        for again in (Converter(c.source()), Converter(c.pretty())):
            assert again.source() == c.source() and again.kind == c.kind
            doc = '{"a":[{"b":"q","y":" x ","z":[1,2]}]}'
            assert again.convert(doc) == c.convert(doc)
    assert Converter(texts[1]).pretty() == '{\n  "[$$]" : "$..b",\n  "[$>]" : {\n    "u" : "ü",\n    "o" : {\n      "p" : "$"\n    }\n  }\n}'
    df = spark.createDataFrame([(1, texts[1]), (2, "{"), (3, '{"{$$}": "$", "{$>}": {"a": [], "b": "$.x::no()"}}'), (4, None)], "id int, t string")
    got = {r["id"]: (r["ok"], r["source"], r["errors"]) for r in check_templates(df, "t").collect()}
    assert got[1] == (True, '{"[$$]":"$..b","[$>]":{"u":"ü","o":{"p":"$"}}}', None) and got[2] == got[4] == (False, None, '"not valid json"')
    assert json.loads(got[3][2]) == {"{$>}": {"a": "an array is not allowed here", "b": "unknown function :: no"}}


def test_sql_functions_are_expressions(spark):
    """No Python in the plan; a filter on a function's argument column reaches the scan."""
    sql.register_classifier(spark, "t_classify", Classifier({1: r"'it' & 'b'", 2: "'q' ~ 'z'", 3: "* & !'x'"}))
    sql.register_hits(spark, "t_hits", Classifier({1: r"'it' & 'b'", 2: "'q' ~ 'z'"}))
    sql.register_validator(spark, "t_validate", Validator('{"a": "gt(1) && _regex(\'^\\\\\\\\d\') || _any", "$$$$": "${a} - 1 > 2 && ${b:3} / 2 == 1"}'))
    sql.register_checks(spark, "t_checks", Validator('{"a": "gt(1)", "$$$$": "${a} > 2"}'))
    sql.register_converter(spark, "t_convert", Converter('{"{$$}": "$", "{$>}": {"b": "$.a", "c": "$.l[?(@.x > 1)].y::trim()"}}'))
    sql.register_path(spark, "t_path", "$..y")
    rows = [(1, "it's b qqz", '{"a":4,"l":[{"x":2,"y":" u "},{"x":1,"y":"w"}]}'), (2, None, '{"a":1}'), (3, "x", "nope"), (4, "", None)]
    spark.createDataFrame(rows, "id int, t string, j string").createOrReplaceTempView("t_rows")
    df = spark.sql("SELECT id, t_classify(t) AS c, t_validate(j) AS v, t_checks(j) AS e, t_convert(j) AS k, t_path(j) AS p FROM t_rows WHERE id > 0")
    got = {r["id"]: r for r in df.collect()}
    assert [got[i]["c"] for i in (1, 2, 3, 4)] == [[2, 3] if False else [1, 2, 3], [], [], [3]]
    assert [got[i]["v"]["ok"] for i in (1, 2, 3, 4)] == [True, False, False, False] and json.loads(got[2]["v"]["error"])["$$$$"]["interim"] == ["(((1 - 1) > 2) && ((_:3 / 2) == 1))"]
    assert [e["detail"] for e in got[2]["e"]] == ["${a} > 2", "1"] and got[1]["e"] == []
    assert got[1]["k"]["value"] == '{"b":4,"c":"u"}' and got[1]["p"] == ['" u "', '"w"'] and got[3]["p"] == [] and got[4]["k"]["error"] == '"not valid json"'
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    hits = spark.sql("SELECT id, h.rule_id, h.rule FROM t_rows, LATERAL t_hits(t) h")
    assert sorted(tuple(r) for r in hits.collect()) == [(1, 1, "(it & b)"), (1, 2, "(q ~ z)")]


def test_doubles_as_sql_writes_them(spark):
    """A number of 10,000,000 and more has no exponent in the query's text."""
    want = {1e7: "10000000.0", 10000145.0: "10000145.0", 24740000.5: "24740000.5", 1.5e15: "1500000000000000.0", 0.0005: "0.0005", -12345678.9: "-12345678.9", 7.0: "7.0", 900.25: "900.25", 0.0: "0.0", 1e20: "1.0E20"}
    got = spark.createDataFrame([(x,) for x in want], "x double").select("x", values.double_as_sql(F.col("x"))).collect()
    assert dict(map(tuple, got)) == want


def test_tree_functions_on_large_parts(spark, tmp_path):
    rows = spark.range(8084, 8088).selectExpr("id AS p_partkey", "'n' AS p_name", "'Brand#12' AS p_brand", "'t' AS p_type", "cast(5 AS int) AS p_size", "901.5D AS p_retailprice")
    rows.write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["fn_toDoubleSep_tree"](spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(k, True, f"{k * 1237}.0") for k in range(8084, 8088)]


def test_customer_balances_of_zero(spark, tmp_path):
    """-0.0 equals 0 in SQL; 0.0 was written with a fraction, so between0's bounds keep theirs."""
    rows = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, 0.5), (4, -1.0), (5, 5000.5), (6, 5000.0), (7, 5001.0)], "c_custkey long, c_acctbal double")
    rows.selectExpr("*", "'Customer#7' AS c_name", "'BUILDING' AS c_mktsegment", "1 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    ok = lambda name: [r["id"] for r in QUERIES[name](spark, str(tmp_path)).filter("ok").orderBy("id").collect()]
    assert ok("val_between0") == [3, 5, 6]
    assert ok("val_digitOr") == [1, 2, 3, 5, 6, 7]
    assert ok("val_lte0") == [1, 2, 3, 4]


def test_occurrences_hold_a_slice_of_a_batch(spark, monkeypatch):
    """A batch goes through in parts by the size of its texts; the rows are the same."""
    monkeypatch.setattr(classifier, "SLICE", 10)
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 4, "b" * 6, None, "", "c" * 50, "d"]})
    parts = list(classifier.slices(batch, 0))
    assert [p.num_rows for p in parts] == [4, 1, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    texts = [None, "", "the the", "x" * 40, "the", "thee " * 9]
    out = Classifier({1: "'the'"}).occurrences(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "t").orderBy("id").collect()
    assert [[list(o["loc"]) for h in r["hits"] for o in h["occurrences"]] for r in out] == [[], [], [[0, 4]], [], [[0]], [[5 * i for i in range(9)]]]


def test_flat_arrays_need_no_count_of_levels(spark):
    """Levels are counted only where arrays lie in arrays; texts with brackets in them change nothing."""
    rows = [('{"a":[{"b":1},{"b":"[[["}]}',), ('{"a":[[{"b":1}],[[{"b":2}]],{"b":3}]}',), ('{"a":[]}',), ('{"a":{"b":4}}',)]
    v = spark.createDataFrame(rows, "json string").select(F.parse_json("json").alias("v"))
    assert [r[0] for r in v.select(F.to_json(Node(F.col("v")).route("a", "b").v)).collect()] == ['[1,"[[["]', "[1,2,3]", None, "4"]

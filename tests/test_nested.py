"""Templates and rules as nested Columns against their form on trees; several relations, doubles, syntax errors as data."""

import json

import pytest
from pyspark.sql import functions as F

from rulespark.functions.cursor import RuleError
from rulespark.functions.relation import EvaluationError, Relation
from rulespark.operators.converter import Converter
from rulespark.operators.paths import json_path, json_path_trees
from rulespark.operators.validator import Validator, check_rules

CARGO = [
    '{"k":1,"bays":[{"id":"A1","kg":"1,200","n":3,"tags":["cold","x"]},{"id":"b 2","kg":"90","n":-4}],"note":" Keep dry ","owner":{"name":"Lo","tel":null}}',
    '{"k":2,"bays":[],"note":"","owner":{"name":"","tel":"7"}}',
    '{"k":"3","bays":[{"id":"Ü\\"9","kg":"x","n":2.5}],"owner":[1,2]}',
    '{"bays":{"id":"C3","kg":"7"},"note":true}',
    "[]",
    '"text"',
    "nope",
    None,
    "",
]
TEMPLATES = [
    '{"[$$]": "$.bays[*]", "[$>]": {"id": "$.id::toLower().replace(\' \', \'-\')", "kg": "@.kg::toLongSep(\',\')", "one": 1, "n": "$.n::toString()"}}',
    '{"{$$}": "$", "{$>}": {"{::}": "$.owner", "{=>}": {"who": "@.name", "key": "$.k"}, "in": {"note": "$.note::trim()", "all": {"[::]": "$.bays[*]", "[=>]": {"id": "@.id", "of": "$.k"}}}, "lit": [1] }}',
    '{"{$$}": "$", "{$>}": {"{::}": "$.owner", "{=>}": {"who": "@.name", "key": "$.k"}, "note": "$.note::trim().toUpper()", "all": {"[::]": "$.bays[?(@.n)]", "[=>]": {"id": "@.id::subString(0, 2)", "of": "$.k"}}}}',
    '{"{$$}": "$", "{$>}": {"{::}": "$.bays[*]", "{=>}": {}, "x": "\\\\$.x", "nul": null}}',
    '{"{$$}": "$.bays[0]", "{$>}": {"t": "$.tags", "a": "$.kg::toDoubleSepOr(\',\', 5).abs().toString()", "b": "$.kg::toLongOr(7)", "c": "$.n::toLongOr(-1)", "d": "$.id::subStringBetween(\'A\', \'1\', \'none\')"}}',
    '{"{$$}": "$.bays[*]", "{$>}": {"n": "$.n"}}',
    '{"{$$}": "$", "{$>}": {"s": "$.owner::toStringOr(\'-\')", "t": "$.owner.tel::toString()", "u": "$.note::toString().replaceIf(\'true\', \'yes\', \'no\')", "v": "$.k::toLong().abs()", "w": "$.k::abs()", "all": "$..id"}}',
    '{"{$$}": "$", "{$>}": {"v": "$.k::toLong().abs().toLower()", "f": "$.note::toDouble().toLongOr(3)", "g": "$.note::regexReplace(\'[a-z]+\', \'$0!\')", "e": {}}}',
]


def loaded(x):
    return None if x is None else json.loads(x)


@pytest.mark.parametrize("template", [t for t in TEMPLATES if '"lit": [1]' not in t])
@pytest.mark.parametrize("semantics", ["reference", "documented"])
def test_templates_as_columns(spark, template, semantics):
    c = Converter(template, semantics)
    df = spark.createDataFrame(list(enumerate(CARGO)), "ok int, json string").withColumnRenamed("ok", "id")
    a, b = (sorted(tuple(r) for r in f(df, "json").collect()) if False else {r["id"]: (r["ok"], loaded(r["value"]), loaded(r["error"])) for r in f(df, "json").collect()} for f in (c.transform, c.transform_trees))
    for i in b:
        assert a[i] == b[i], (CARGO[i], a[i], b[i])
    assert ("InArrow" in c.transform(df, "json")._jdf.queryExecution().executedPlan().toString()) == ("$.k::abs()" in template)  # abs of a node has no Column form


def test_arrays_are_no_literals():
    with pytest.raises(RuleError):
        Converter(TEMPLATES[1])


RULES = [
    '{"k": "gt(1)", "bays": [{"id": "_isString", "kg": "_charsIn(\'0123456789,\')", "_?_:n": "gte(0)"}], "_?_:note": "_notEmptyString"}',
    '[{"id": "_any"}]',
    '{"owner": {"name": "_longerThan(1)", "_?_:tel": "_notNull", "$$$$": "${age:1} > 0"}, "$$$$": "${k} * 2 > 2 && ${k} / (${k} - 2) < 9"}',
    '{"$$$$": ["${k} > 1", "${none} < 3", "${k} + ${owner.tel:4} == 9"]}',
    '{"bays": {"id": "_any"}, "note": [{"x": "_any"}], "k": {"z": "_any"}}',
    "{}",
]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("as_float", [False, True])
def test_error_trees_as_columns(spark, rule, as_float):
    v = Validator(rule, as_float=as_float)
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(CARGO)], "id int, json string, __o string")
    df = df.withColumnRenamed("__o", "errors")
    a, b = ({r["id"]: (r["ok"], loaded(r["value"]), loaded(r["error"]), r["errors"]) for r in f(df, "json").collect()} for f in (v.report, v.report_trees))
    for i in b:
        assert a[i] == b[i], (CARGO[i], a[i], b[i])
    flat = {r["id"]: r["ok"] for r in v.transform(df.drop("errors"), "json").collect()}
    assert flat == {i: r[0] for i, r in a.items()}
    assert "InArrow" not in v.report(df, "json")._jdf.queryExecution().executedPlan().toString()


def test_several_relations(spark):
    r = Relation(["${a} > 1", "${b} < ${a}", "${c} / ${b} == 2"])
    docs = ['{"a":2,"b":1,"c":2}', '{"a":2,"b":3,"c":6}', '{"a":2,"b":0,"c":6}', '{"b":1}', '{"a":"x","b":1,"c":2}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, json string").withColumn("v", F.parse_json("json"))
    error, false = (lambda x: F.array_join(x, ";")), (lambda x: F.concat(F.lit("false "), F.array_join(x, ";")))
    got = [(x[1], x[2]) for x in df.select("id", r.outcome(F.col("v")), r.report(F.col("v"), error, false)).orderBy("id").collect()]
    assert got == [(0, None), (1, "false (2 > 1);(3 < 2);((6 / 3) == 2)"), (2, "divide by zero :: ${b:_}"), (2, "a => not found;a => not found;c => not found"), (2, "a => x is not long;a => x is not long")]
    for doc, (_, said) in zip(docs, got, strict=True):
        try:
            assert r.test(_parsed(doc)) == (said is None)
        except EvaluationError as e:
            assert ";".join(e.args) == said
    assert str(r) == "(${a:_} > 1),(${b:_} < ${a:_}),((${c:_} / ${b:_}) == 2)"
    with pytest.raises(RuleError) as e:
        Relation(["${a} > 1", "${a} >", "> 2"])
    assert e.value.kind == "object" and e.value.tree["result"] == ["syntax error :: ${a} >", "syntax error :: > 2"]


def _parsed(text):
    from rulespark.functions.jsonvalue import parse

    return parse(text)


def test_fields_are_looked_up_once(spark):
    """However often the expressions name a field, the plan looks it up once."""
    v = Validator('{"$$$$": ["${q} > 1 && ${q} < 7", "${q} * ${n} != ${q} + ${n}", "${q} != 5"]}')
    df = spark.createDataFrame([('{"q":3,"n":2}',)], "json string")
    plan = v.transform(df, "json")._jdf.queryExecution().optimizedPlan().toString()
    assert v.transform(df, "json").first()["ok"] and plan.count("$['q']") == 1


def test_relations_over_doubles(spark):
    docs = ['{"a":1,"b":"0.75"}', '{"a":1.5,"b":2}', '{"a":0,"b":0}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, json string")
    rule = '{"$$$$": "${b} / ${a} < 1"}'
    assert {r["id"]: r["ok"] for r in Validator(rule, as_float=True).transform(df, "json").collect()} == {0: True, 1: False, 2: False}
    assert {r["id"]: r["ok"] for r in Validator(rule).transform(df, "json").collect()} == {0: False, 1: False, 2: False}


def test_syntax_errors_as_data(spark):
    bad = [
        ('{"a": "gt(x) && foo", "b": {"c": "_any &&"}, "l": [{"d": "between(1)"}], "$$$$": "${a} >"}', [("$.a", "value", "type error(x is not long):: gt(x)"), ("$.a", "value", "unknown-function:: foo"), ("$.b.c", "syntax", "syntax error :: _any &&"), ("$.l[].d", "value", "arg-count must 2 :: between(1)"), ("$.$$$$", "object", "syntax error :: ${a} >")]),
        ('{"a": 1, "b": ["_any"], "c": []}', [("$.a", "node", "not String/Object/Array:: 1"), ("$.b", "node", "not Object/Array: _any"), ("$.c", "node", "Array must have a single-element :: 1 != 0")]),
        ("{", [("$", "json", "Invalid JSON string")]),
        ('"x"', [("$", "node", "not Object/Array: x")]),
        ('{"a": "_any"}', []),
        (None, [("$", "json", "Invalid JSON string")]),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(bad)], "id int, rule string")
    got = {r["id"]: r for r in check_rules(df, "rule").collect()}
    for i, (_, faults) in enumerate(bad):
        assert [tuple(f) for f in got[i]["faults"]] == faults and got[i]["ok"] == (not faults)
    assert json.loads(got[0]["tree"])["l"] == [{"d": {"type": "Value Syntax error", "value": "between(1)", "result": ["arg-count must 2 :: between(1)"]}}]


def test_what_lies_below_is_sorted_by_keys_made_once(spark):
    """No lambda compares nodes: n log n calls of an expression that makes two keys each. More than ten children keep their order."""
    doc = '{"a":[' + ",".join(f'{{"x":{i},"y":[{i},{{"x":{-i}}}]}}' for i in range(13)) + '],"b":{"x":[]}}'
    df = spark.createDataFrame([(doc,)], "json string")
    for path in ("$..*", "$..x", "$..[?(@.x)]"):
        out = json_path(df, "json", path)
        assert out.first()["nodes"] == json_path(df, "json", path, keep_order=True).first()["nodes"]
        assert "array_sort" not in out._jdf.queryExecution().analyzed().toString()


SLICES = ["[-2:]", "[1:]", "[:2]", "[1:3]", "[3:1]", "[-3:-1]", "[0:6:2]", "[-4::3]", "[-9:]", "[-9::2]", "[5:]", "[2147483647:]", "[-2147483648::2]", "[:3000000000]", "[::-1]"]


@pytest.mark.parametrize("part", SLICES)
def test_slices_as_on_trees(spark, part):
    docs = ['{"a": %s}' % json.dumps(x) for x in (*(list(range(n)) for n in range(8)), [None, [1], {"b": 2}, "x"], {"b": 1}, "text", None)] + ["{}", "bad", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, json string")
    got, want = ({r["id"]: r["nodes"] for r in f(df, "json", f"$.a{part}").collect()} for f in (json_path, json_path_trees))
    assert got == want


@pytest.mark.parametrize("part", ["[-2:]", "[1:]", "[-4::3]"])
def test_slices_make_an_array_once(spark, part):
    """Its elements are looked up once an array; within the filter over elements that would be once for each."""
    df = spark.createDataFrame([('{"a": [1, 2, 3]}',)], "json string")
    plan = json_path(df, "json", f"$.a{part}")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrayType(VariantType") == 1, plan

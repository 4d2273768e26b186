"""The three engines: languages, both evaluation forms, error trees, streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rulespark.functions import jsonpath
from rulespark.functions.cursor import RuleError
from rulespark.functions.jsonvalue import double_text, dump, parse
from rulespark.functions.pattern import parse as pattern
from rulespark.functions.predicate import PREDICATES, ValueRule
from rulespark.functions.relation import EvaluationError, Relation
from rulespark.functions.values import FUNCTIONS, compile_chain, run_chain
from rulespark.operators.classifier import Classifier, Engine
from rulespark.operators.converter import Converter
from rulespark.operators.paths import json_path, json_path_trees
from rulespark.operators.validator import Validator

HARBOUR = (
    '{"port":{"ship":[{"flag":"PA","name":"Odo","draft":4.5,"crew":[12,3]},{"flag":"LR","name":"Ute","draft":11.25},'
    '{"flag":"LR","name":"Ina","imo":"97-1","draft":6.75},{"flag":"MT","name":"Kai","imo":"97-2","draft":14.5,"towed":true}],'
    '"ferry":{"ship":{"name":"Pia","draft":2.25},"hull":"steel","draft":3.5},"draft":16},"limit":7}'
)


# -- classifier


@pytest.mark.parametrize(
    "text, shown",
    [
        ("'a'", "a"), ("^'a'", "^a"), ("'a'$", "a$"), ("^'a'$", "^a$"), ("*", "*"), ("'a' ~'b'~ 'c'", "(a ~ b ~ c)"), ("!{'a' | ('b' & !'c')}", "!(a | (b & !c))"),
        ("'a' | 'b' & 'c'", "(a | (b & c))"), ("!(!'a')", "a"), (r"'it\'s'", r"it\'s"), ("!('a' ~ 'b')", "!(a ~ b)"),
    ],
)
def test_patterns(text, shown):
    assert str(pattern(text)) == shown


@pytest.mark.parametrize("text", ["", "a", "'a' &", "!'a' ~ 'b'", "!!'a'", "('a'", "'a' 'b'", "''"])
def test_bad_patterns(text):
    with pytest.raises(RuleError):
        pattern(text)


RULES = {1: "'ab' & 'c'", 2: "'ab' ~ 'abc'", 3: "!('x' | 'y')", 4: "!('x' & 'y')", 5: "* & !'z'", 6: "!'z'", 7: "'c' ~ 'ab'", 8: "^'ab'$", 9: "'q' | {'x' & 'y'}", 10: "'x' ~ * ~ 'y'"}
TEXTS = ["", None, "abc", "ABC c", "xy", "x", "y x", "zz", "c ab", "ab", "qz", "İab"]


@pytest.mark.parametrize("semantics", ["reference", "documented"])
def test_classifier_forms_agree(spark, semantics):
    c = Classifier(RULES, semantics=semantics)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    native = {r["id"]: r["rule_ids"] for r in c.transform(df, "text", native=True).collect()}
    other = {r["id"]: r["rule_ids"] for r in c.transform(df, "text", native=False).collect()}
    assert native == other
    assert native[1] == [] and 5 in native[0] and 6 not in native[0]


def test_classifier_semantics():
    hits = lambda text, **k: [h["rule_id"] for h in Engine(Classifier(RULES, **k).rules, k.get("semantics") == "documented").search(text)]
    assert 3 in hits("x") and 3 not in hits("xy") and 4 not in hits("x")
    assert 3 not in hits("x", semantics="documented") and 4 in hits("x", semantics="documented")
    assert 8 in hits("xxab") and 8 not in hits("xxab", semantics="documented")
    assert Engine(Classifier({1: "'a' & 'A'"}).rules, False).search("aba")[0]["occurrences"] == [{"keyword": "A", "loc": [0, 2]}, {"keyword": "a", "loc": [0, 2]}]
    assert Engine(Classifier({1: "'a' & 'a'"}).rules, False).search("aba")[0]["occurrences"] == [{"keyword": "a", "loc": [0, 0, 2, 2]}]


def test_rule_sets():
    with pytest.raises(RuleError) as e:
        Classifier({1: "'a'", 2: "b"})
    assert e.value.tree == {2: "b"}
    assert list(Classifier({1: "'a'", 2: "b"}, ignore_invalid=True).rules) == [1]
    with pytest.raises(ValueError):
        Classifier([(1, "'a'"), (1, "'b'")])


# -- validator

VALUES = ["null", "true", '""', '"12"', '"+7"', '"-3.5"', '" 12 "', '"abc"', '"x1y"', '"2024-02-31"', "0", "50", "-7", "50.5", "1e3", "12345678901234567890", '"1.5e2"', '"٣"', '"a]b^-"']
CALLS = [
    *(f"{p}{n}{s}({a})" for p in ("", "_") for n, a in (("gt", "50"), ("lt", "50"), ("gte", "50"), ("lte", "50"), ("between", "1,50")) for s in ("", "0")),
    "gt0(50.5)", "gte0(49.5)", "_any", "_notNull", "_isString", "_notEmptyString", "_oneOf(abc,'12')", "_notOneOf(abc)", "_digit", "_digitOr('+-.')", "_charsIn('abc]^-')", "_charsNotIn('x]')",
    "_regex('^1', 'b')", "_date('${yyyy}-${mm}-${dd}')", "_length(2,3)", "_longerThan(2)", "_shorterThan(3)", "_digit && _length(2) || gt(10)", "(_digit || _any) && _notNull",
]


@pytest.mark.parametrize("documented", [False, True])
def test_predicate_forms_agree(spark, documented):
    rules = [ValueRule(c, documented) for c in CALLS]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id int, json string").withColumn("v", F.try_parse_json("json"))
    got = {r["id"]: r for r in df.select("id", *[r.column(F.col("v")).alias(f"c{i}") for i, r in enumerate(rules)]).collect()}
    wrong = [(c, v, got[i][f"c{k}"]) for i, v in enumerate(VALUES) for k, (c, r) in enumerate(zip(CALLS, rules)) if got[i][f"c{k}"] != r.test(parse(v))]
    assert wrong == []


def test_predicates_are_all_there():
    assert len(PREDICATES) == 35


def test_value_rule_errors():
    with pytest.raises(RuleError) as e:
        ValueRule("knots(3) || between(1) && (port || _longerThan(deep)) && _digit")
    assert e.value.tree["result"] == ["unknown-function:: knots(3)", "arg-count must 2 :: between(1)", "unknown-function:: port", "type error(deep is not long):: _longerThan(deep)"]
    with pytest.raises(RuleError) as e:
        Validator('{"ship": [{"draft": "gt(5) || && lt(9)", "name": "_any"}]} ### a comment')
    assert dump(e.value.tree) == '{"ship":[{"draft":"syntax error :: gt(5) || && lt(9)"}]}'
    for bad in ["[", '"x"', '["_any"]', '{"a": 1}', '[{"a": "_any"}, {"b": "_any"}]', '{"$$$$": "${a} >"}', '{"a": "between(1)"}']:
        with pytest.raises(RuleError):
            Validator(bad)


RELATIONS = ["${a} >= 4", "3 * (${b} - ${a}) <= ${a} || ${b} == 0", "${c:8} - ${a} != 4 && (${b} < 1 || ${a} > ${b})", "${a} / ${b} >= 2", "${d.e} - 1 == ${a}", "0 - ${a} / 2 <= ${b}"]
DOCS = ['{"a":4,"b":2}', '{"a":"4","b":0}', '{"a":4.9,"b":"x"}', '{"a":-7,"b":2,"c":8,"d":{"e":"-6"}}', "{}", '{"a":null,"b":[]}']


def test_relation_forms_agree(spark):
    rules = [Relation(r) for r in RELATIONS]

    def python(r, d):
        try:
            return "true" if r.test(parse(d)) else "false"
        except EvaluationError:
            return "error"

    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, json string").withColumn("v", F.parse_json("json"))
    cols = [F.when(f, "error").when(t, "true").otherwise("false").alias(f"c{i}") for i, (t, f) in enumerate(r.column(F.col("v")) for r in rules)]
    for row in df.select("id", *cols).collect():
        assert [row[f"c{i}"] for i in range(len(rules))] == [python(r, DOCS[row["id"]]) for r in rules], DOCS[row["id"]]


RULE = '{"a":"_between(1,100) && _digit","_?_:b":"gt(3)","$$$$":"${a} + 2 * (${c:7} - 1) > 12","l":[{"x":"_any"}]}'


def test_validator_forms_agree(spark):
    v = Validator(RULE)
    docs = ['{"a":"12","l":[{"x":1,"y":2}]}', '{"a":"x","b":1,"l":[{"z":1},3]}', '{"l":7}', "[]", "nope", None, '{"a":"0","b":4,"l":[]}']
    df = spark.createDataFrame(list(enumerate(docs)), "id int, json string")
    flat = {r["id"]: r for r in v.transform(df, "json").collect()}
    tree = {r["id"]: r for r in v.report(df, "json").collect()}
    assert {i: r["ok"] for i, r in flat.items()} == {i: r["ok"] for i, r in tree.items()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert tree[0]["value"] == '{"a":"12","b":null,"l":[{"x":1}]}'
    assert json.loads(tree[1]["error"])["l"][0]["x"] == {"type": "Key does not exist", "error": "Key(x) must exist."}
    assert sorted(e["path"] for e in flat[1]["errors"]) == ["$.$$$$", "$.a", "$.b", "$.l[]", "$.l[].x"]
    assert json.loads(tree[4]["error"]) == "not valid json"


# -- paths and functions

PATHS = {
    "$.port.ship[1:2].name": ["Ute"], "$.port.ship[?(@.imo)].name": ["Ina", "Kai"], "$.port.ship[-1].name": [], "$['port'].'ferry'['hull']": ["steel"], "$.port.ship[3,1].flag": ["MT", "LR"],
    "$..ship[-2:].name": ["Ina", "Kai"], "$.port..draft": [4.5, 11.25, 6.75, 14.5, 2.25, 3.5, 16], "$.port.ship[?(@.draft < $.limit)].name": ["Odo", "Ina"], "$.port.ship[*].towed": [True],
    "$.port.ship[?(@.name =~ '(?i)[ou]')].draft": [4.5, 11.25], "$.port.ship[?(@.draft > 7 && (@.imo || @.flag == 'LR'))].name": ["Ute", "Kai"], "$.port.ship[0:4:2].name": ["Odo", "Ina"],
    "$.port.ferry[?(@.name)].name": ["Pia"], "$.port['draft','none']": [16], "$.none.x": [], "$.port.ship.name": [], "$.port.ship[?(@.none != 1)]": [], "$.port.ship[3:1].name": ["Ute", "Ina"],
    "$.port.ship[*].crew[*]": [12, 3], "$..crew[?(@ > 5)]": [12], "$.port.ship[?(@.crew[*] == 3)].name": ["Odo"], "$.port.ship[?(@.draft == $..ferry.draft)]": [], "$.port.ship[?('LR' == @.flag)].name": ["Ute", "Ina"],
    "$..name": ["Odo", "Ute", "Ina", "Kai", "Pia"], "$.port.ship[0].*": ["PA", "Odo", 4.5, [12, 3]], "$..[?(@.hull)].hull": ["steel"], "$.port.ship[?(@.*)].name": ["Odo", "Ute", "Ina", "Kai"],
}
#: What a VARIANT gives in another order, or writes otherwise.
BY_KEY = {"$.port..draft", "$..name", "$.port.ship[0].*"}


@pytest.mark.parametrize("path", list(PATHS))
def test_paths(path):
    doc = parse(HARBOUR)
    assert jsonpath.find(jsonpath.parse_path(path), doc, doc) == PATHS[path]


def test_path_forms_agree(spark):
    df = spark.createDataFrame([(HARBOUR,), ("nope",), (None,), ('{"port":[1,{"ship":[]}]}',), ("[[[]],{}]",), ('"x"',)], "json string")
    assert "InArrow" not in json_path(df, "json", "$..*")._jdf.queryExecution().executedPlan().toString()
    for path in [*PATHS, "$..*", "$..[?(@)]", "$.*", "$[*]..*"]:
        a, b = ([[json.loads(x) for x in r["nodes"]] for r in f(df, "json", path).collect()] for f in (json_path, json_path_trees))
        if path in BY_KEY or path not in PATHS:
            a, b = ([sorted(map(repr_sorted, x)) for x in y] for y in (a, b))
        assert a == b, path


def repr_sorted(x) -> str:
    return json.dumps(x, sort_keys=True)


def test_recursion_in_order_of_keys(spark):
    """Where keys stand in order of name anyway, Columns give what trees give, in their order."""
    doc = '{"a":{"k":1,"l":[{"k":2},{"k":{"k":3}}]},"k":[{"k":4}],"m":{"a":5}}'
    df = spark.createDataFrame([(doc,)], "json string")
    for path in ["$..k", "$..*", "$..a", "$..[?(@.k)]", "$.a..k", "$..l[*].k", "$.*.k"]:
        assert json_path(df, "json", path).first()["nodes"] == json_path_trees(df, "json", path).first()["nodes"], path


def test_repeated_keys_and_order():
    doc = parse('{"b":1,"a":2,"b":3}')
    assert jsonpath.find(jsonpath.parse_path("$.b"), doc, doc) == [1] and jsonpath.find(jsonpath.parse_path("$.*"), doc, doc) == [1, 2, 3]


@pytest.mark.parametrize("path", ["$.", "$[", "$..", "$.a[?(@.b ==)]extra", "$.a b", "$[0:1:0]", "$.a[?(@.b =~ '(')]"])
def test_bad_paths(path):
    with pytest.raises(RuleError):
        jsonpath.parse_path(path)


CHAINS = [
    ("trim()", "\t a \n", "a"), ("toLower()", "AbC", "abc"), ("toUpper()", "AbC", "ABC"), ("toLong()", "+12", 12), ("toLong()", "12.5", None), ("toLong()", 12, None), ("toDouble()", "1.5", 1.5),
    ("toLongOr(7)", "x", 7), ("toLongOr(-7)", None, -7), ("toDoubleOr(7)", "x", 7.0), ("toLongSep(',')", "1,234", 1234), ("toLongSep(',')", "1234", None), ("toLongSep(',')", "1,234.5", None),
    ("toDoubleSep(',')", "-1,234.5", -1234.5), ("toLongSepOr(',', 5)", "1,234.5", 5), ("toLongSepOr(',', 5)", "x", None), ("toDoubleSepOr(',', 5)", "1,234", 1234.0), ("subString(1,3)", "abcd", "bc"),
    ("subString(-2,0)", "abcd", "cd"), ("subString(0,9)", "abcd", None), ("replace('b','-')", "abcb", "a-c-"), ("regexReplace('(b)(c)','$2$1')", "abc", "acb"), ("_regex('b','')", "abc", "ac"),
    ("replaceIf('a','t','f')", "a", "t"), ("replaceIf('a','t','f')", "b", "f"), ("subStringBetween('<','>','d')", "x<y>z", "y"), ("subStringBetween('<','>','d')", "xyz", "d"), ("abs()", -3, 3),
    ("abs()", "-3", None), ("toString()", 1.0e10, "1.0E10"), ("toString()", None, ""), ("asString()", True, "true"), ("toStringOr('d')", None, "d"), ("toString().toLong().abs()", -5, 5),
]


@pytest.mark.parametrize("calls, value, expected", CHAINS)
def test_functions(calls, value, expected):
    chain = compile_chain(jsonpath.parse_with_functions("$.x::" + calls)[1])
    if expected is None:
        with pytest.raises(ValueError):
            run_chain(chain, value)
    else:
        got = run_chain(chain, value)
        assert got == expected and type(got) is type(expected)


def test_function_errors():
    assert len(FUNCTIONS) == 19
    for bad in ["nope()", "trim(1)", "subString(1)", "toLongOr('x')", "regexReplace('(', '')"]:
        with pytest.raises(RuleError):
            compile_chain(jsonpath.parse_with_functions("$.x::" + bad)[1])


def test_double_text():
    assert [double_text(x) for x in (8.95, 100.0, 1e7, 1.5e-5, -0.001, 123456789.0)] == ["8.95", "100.0", "1.0E7", "1.5E-5", "-0.001", "1.23456789E8"]


# -- converter


def convert(template: str, doc: str = HARBOUR):
    ok, value, error = Converter(template).convert(doc)
    return json.loads(value if ok else error)


def test_converter():
    assert convert('{"[$$]": "$.port.ship[*]", "[$>]": {"t": "$.name", "n": null, "e": "\\\\$x"}}')[0] == {"t": "Odo", "n": None, "e": "$x"}
    merged = Converter('{"{$$}": "$", "{$>}": {"x": "$.limit", "{::}": "$.port.ferry", "{=>}": {"c": "@.hull", "r": "$.limit"}}}').convert(HARBOUR)[1]
    assert merged == '{"c":"steel","r":7,"x":7}'
    assert convert('{"{$$}": "$.port", "{$>}": {"l": {"[::]": "@.ship[?(@.draft > 7)]", "[=>]": {"t": "@.name", "p": "$.draft"}}, "none": {"[::]": "$.zip[*]", "[=>]": {}}}}') == {"l": [{"t": "Ute", "p": 16}, {"t": "Kai", "p": 16}], "none": []}


def test_converter_failures():
    assert convert('{"{$$}": "$", "{$>}": {"a": "$.nope", "b": {"c": "$..draft"}, "d": "$.limit::toLong()"}}') == {"a": "$.nope: not found", "b": {"c": "$..draft: too many(7)[4.5,11.25,6.75,14.5,2.25,3.5,16]"}, "d": "$.limit::toLong(): manipulate fail : toLong :: not String"}
    assert convert('{"[$$]": "$.port.ship[*]", "[$>]": {"i": "$.imo"}}') == {"[$>]": [{"i": "$.imo: not found"}] * 2}
    assert convert('{"[$$]": "$.port.ship[*]", "[$>]": {"i": "$.sail"}}') == {"[$$]": "$.port.ship[*] : 4 -> empty", "[$>]": [{"i": "$.sail: not found"}] * 4}
    assert convert('{"[$$]": "$.none[*]", "[$>]": {}}') == {"[$$]": "$.none[*] : 0 -> empty"}
    assert convert('{"{$$}": "$..draft", "{$>}": {}}') == "{$$} : too many(7)"
    assert convert('{"{$$}": "$", "{$>}": {}}', "nope") == "not valid json"
    for bad in ["[]", "{}", '{"{$$}": "$"}', '{"{$$}": "x", "{$>}": {}}', '{"{$$}": "$", "{$>}": {"a": []}}', '{"{$$}": "$", "{$>}": {"a": "$.x::no()"}}', '{"{$$}": "$", "{$>}": {"a": {"[::]": "$.x"}}}', '{"{$$}": "$", "{$>}": {}, "[$$]": "$", "[$>]": {}}']:
        with pytest.raises(RuleError):
            Converter(bad)


# -- SQL, streams, sources


def test_sql_functions(spark):
    from rulespark.operators import sql

    sql.register_classifier(spark, "classify", Classifier({1: "'a'", 2: "'b'"}))
    sql.register_validator(spark, "json_validate", Validator('{"a": "gt(1)"}'))
    sql.register_converter(spark, "json_convert", Converter('{"{$$}": "$", "{$>}": {"b": "$.a"}}'))
    sql.register_path(spark, "json_path_a", "$.a")
    r = spark.sql("""SELECT classify('ab') AS c, json_validate('{"a":2}').ok AS v, json_convert('{"a":2}').value AS t, json_path_a('{"a":2}') AS p""").first()
    assert (r["c"], r["v"], r["t"], r["p"]) == ([1, 2], True, '{"b":2}', ["2"])


def test_stream(spark, tmp_path):
    from rulespark.streaming import apply

    rows = [(i, "2024-01-01 00:0%d:00" % i, "the a" if i % 2 else "b") for i in range(6)]
    df = spark.createDataFrame(rows, "id int, t string, text string").selectExpr("id", "cast(t AS timestamp) AS t", "text")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    c = Classifier({1: "'the'", 2: "'b' | 'a'"})
    for name, out, mode in (("hits", apply.classify(stream, "text", c), "append"), ("windows", apply.hits_per_window(stream, "text", "t", c), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert sorted((r["id"], r["rule_id"]) for r in spark.table("hits").collect()) == sorted((r["id"], r["rule_id"]) for r in c.rows(df, "text").collect())
    assert sum(r["count"] for r in spark.table("windows").collect()) == 9


def test_sources(spark, tmp_path):
    import gzip

    from rulespark.sources import documents as src

    with gzip.open(f"{tmp_path}/a.json.gz", "wt") as f:
        f.write('{"a":1}\n{"a":2}\n')
    (tmp_path / "rule.json").write_text('{"a": ### a comment\n "gt(1)"}')
    assert src.json_lines(spark, f"{tmp_path}/a.json.gz").count() == 2
    v = Validator(src.load_rule(spark, f"{tmp_path}/rule.json"))
    assert [r["ok"] for r in v.transform(src.json_lines(spark, f"{tmp_path}/a.json.gz"), "json").orderBy("json").collect()] == [False, True]
    df = spark.createDataFrame([(gzip.compress(b"x"),), (b"no",), (None,)], "b binary")
    assert [r[0] for r in df.select(src.gunzip("b")).collect()] == ["x", None, None]


# -- queries against DuckDB

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    from rulespark.plans.library import ORACLES, QUERIES  # all: library adds its own to those of catalogue

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    assert set(ORACLES) == set(QUERIES)
    wrong = []
    for name, run in QUERIES.items():
        df = run(spark, SF)
        cols = sorted(df.columns)
        got = sorted((tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in df.select(cols).collect()), key=repr)
        want = sorted((tuple(float(v) if isinstance(v, (int, float)) else v for v in r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()), key=repr)
        if got != want:
            wrong.append(name)
    assert wrong == []

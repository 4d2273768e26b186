"""Queries of the parts around the engines: navigation, strings and times, SQL functions, compile errors as data, sources."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import predicate, strings, values
from ..functions.navigate import Node
from ..operators import sql
from ..operators.classifier import Classifier, exact_lookup
from ..operators.converter import Converter, check_templates
from ..operators.paths import printed_paths
from ..operators.validator import Validator, check_rules
from ..sources.documents import gunzip, pretty, table
from .catalogue import CUSTOMER, EVENT, LINE, ORACLES, PART, QUERIES, J, K, _over, add, documents_of, has, orders_json, seq

__all__ = ["ORACLES", "QUERIES"]

# -- exact lookup and rule sets


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"K": '), F.col("o_orderkey").cast("string"), F.lit("}")).alias("keyword"))
    return exact_lookup(table(spark, d, "events").select("event_id", "props"), "props", keys).select("event_id", "keyword_id")


add("cls_exact_lookup", _lookup, """SELECT event_id, o_orderkey AS keyword_id FROM events JOIN orders ON lower('{"K": ' || o_orderkey || '}') = lower(props)""")


def _rules_of_table(spark: SparkSession, d: str) -> DataFrame:
    rules = {r[0]: f"'{r[1][:3].lower()}'" if r[0] % 2 else r[1] for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()}  # nations are few
    c = Classifier(rules, ignore_invalid=True)
    return c.rows(table(spark, d, "documents").select("doc_id", "text"), "text").groupBy("rule_id", "rule").agg(F.count("*").alias("docs"))


add("cls_rules_ignore_invalid", _rules_of_table, "SELECT n_nationkey AS rule_id, lower(substring(n_name, 1, 3)) AS rule, count(*) AS docs FROM nation JOIN documents ON contains(lower(text), lower(substring(n_name, 1, 3))) WHERE n_nationkey % 2 = 1 GROUP BY ALL")
add(
    "cls_keyword_escape",
    lambda spark, d: table(spark, d, "documents").select("doc_id", Classifier({1: r"'the\'s' & 'the'"}).matches(1, F.replace("text", F.lit("the "), F.lit(r"the\'S "))).alias("hit")),
    r"SELECT doc_id, coalesce(contains(lower(replace(text, 'the ', 'the\''S ')), 'the\''s'), false) AS hit FROM documents",
)

# -- navigation


def _nav(source, *cols):
    def run(spark, d):
        docs = orders_json(spark, d) if source is None else documents_of(spark, d, source)
        return docs.withColumn("v", F.try_parse_json("json")).select("id", *[make(Node(F.col("v"))).alias(name) for name, make in cols])

    return run


def _size(x: Column) -> Column:
    return F.size(x).cast("bigint")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.try_variant_get(v, "$", "double"))


add("nav_route_over_arrays", _nav(None, ("n", lambda r: _size(r.route("items", "qty").as_list())), ("total", lambda r: _sum(r.route("items", "qty").as_list()))), _over("l_quantity"))
add("nav_route_errors", _nav(None, ("cust", lambda r: Node(r.get("head", "cust").value).to_long().value), ("why", lambda r: F.substring(r.get("head", "none").error, 1, 24))), f"SELECT DISTINCT o_orderkey AS id, o_custkey AS cust, 'not exist: head.none in ' AS why FROM {J}")
add("nav_as_list", _nav(None, ("items", lambda r: _size(r.field("items").as_list())), ("head", lambda r: _size(r.field("head").as_list()))), f"SELECT o_orderkey AS id, count(*) AS items, 1 AS head FROM {J} GROUP BY o_orderkey")
add("nav_array_values", _nav(None, ("n", lambda r: _size(r.field("items").as_array_values().value)), ("why", lambda r: r.field("status").as_array_values().error)), f"SELECT o_orderkey AS id, count(*) AS n, 'not JArray : \"' || o_orderstatus || '\"' AS why FROM {J} GROUP BY o_orderkey, o_orderstatus")
add("nav_object_values", _nav(None, ("keys", lambda r: F.array_join(F.transform(r.field("head").as_object_values().value, lambda e: e["key"]), ",")), ("cust", lambda r: Node(F.get(r.field("head").as_object_values().value, F.lit(0))["value"]).as_long().value)), f"SELECT DISTINCT o_orderkey AS id, 'cust,prio' AS keys, o_custkey AS cust FROM {J}")
add("nav_to_long", _nav(PART, ("size", lambda r: r.field("size").to_long().value), ("n", lambda r: r.field("n").to_long().value), ("why", lambda r: r.field("brand").to_long().error)), "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size, CAST(p_size AS BIGINT) AS n, 'string(' || p_brand || ') to Long failed' AS why FROM part")
add("nav_to_double", _nav(PART, ("price", lambda r: r.field("price").to_double().value), ("n", lambda r: r.field("n").to_double().value), ("ok", lambda r: r.field("name").to_double().error.isNull())), "SELECT p_partkey AS id, p_retailprice AS price, CAST(p_size AS DOUBLE) AS n, false AS ok FROM part")
add("nav_to_decimal", _nav(CUSTOMER, ("bal", lambda r: r.field("bal").to_decimal().value.cast("decimal(18,2)").cast("double")), ("text", lambda r: r.field("balance").to_decimal().value.cast("decimal(18,2)").cast("double"))), "SELECT c_custkey AS id, c_acctbal AS bal, c_acctbal AS text FROM customer")
add("nav_to_big_int", _nav(CUSTOMER, ("key", lambda r: r.field("key").to_big_int().value.cast("bigint")), ("cut", lambda r: r.field("bal").to_big_int().value.cast("bigint"))), "SELECT c_custkey AS id, c_custkey AS key, CAST(trunc(c_acctbal) AS BIGINT) AS cut FROM customer")
add(
    "nav_as_types",
    _nav(CUSTOMER, ("name", lambda r: r.field("name").as_string().value), ("nation", lambda r: r.field("nation").as_big_int().value.cast("int")), ("numeric", lambda r: r.field("bal").as_numeric().value.isNotNull()), ("object", lambda r: r.field("bal").as_object().value.isNotNull()), ("bool", lambda r: r.field("name").as_boolean().error)),
    "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, true AS numeric, false AS object, 'not Bool : \"' || c_name || '\"' AS bool FROM customer",
)
STATES = ("CASE event_id % 3 WHEN 0 THEN '{\"k\": null}' WHEN 1 THEN '{}' ELSE props END", "events", "event_id")
add(
    "nav_states",
    _nav(STATES, ("nothing", lambda r: r.field("k").is_nothing()), ("nul", lambda r: r.field("k").is_null()), ("not_null", lambda r: r.field("k").not_null()), ("there", lambda r: r.field("k").non_empty().isNotNull())),
    "SELECT event_id AS id, event_id % 3 = 1 AS nothing, event_id % 3 = 0 AS nul, event_id % 3 <> 0 AS not_null, event_id % 3 <> 1 AS there FROM events",
)
add("nav_matches", _nav(CUSTOMER, ("hit", lambda r: r.field("seg").matches("^[AB].*[DGE]$")), ("number", lambda r: r.field("bal").matches("."))), "SELECT c_custkey AS id, regexp_matches(c_mktsegment, '^[AB].*[DGE]$') AS hit, false AS number FROM customer")

# -- relations


def _lines(rule: str, **options):
    v = Validator(rule, **options)
    return lambda spark, d: v.transform(table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{LINE} AS json"), "json").select("l_orderkey", "l_linenumber", "ok", F.get("errors", F.lit(0))["type"].alias("type"))


_Q, _N = "CAST(l_quantity AS BIGINT)", "CAST(l_linenumber AS BIGINT)"
add(
    "rel_several",
    _lines('{"$$$$": ["${q} > ${n}", "${q} / (${n} - 1) < 30", "${s} != ${p}"]}'),
    f"SELECT l_orderkey, l_linenumber, {_N} <> 1 AND {_Q} > {_N} AND {_Q} // nullif({_N} - 1, 0) < 30 AND l_suppkey <> l_partkey AS ok, CASE WHEN {_N} = 1 THEN 'Object-Evaluation Error' WHEN NOT ({_Q} > {_N} AND {_Q} // nullif({_N} - 1, 0) < 30 AND l_suppkey <> l_partkey) THEN 'Object-Evaluation result is false' END AS type FROM lineitem",
)
add(
    "rel_float",
    _lines('{"$$$$": "${q} / ${n} * 2 > 7"}', as_float=True),
    f"SELECT l_orderkey, l_linenumber, CAST({_Q} AS DOUBLE) / {_N} * 2 > 7 AS ok, CASE WHEN NOT CAST({_Q} AS DOUBLE) / {_N} * 2 > 7 THEN 'Object-Evaluation result is false' END AS type FROM lineitem",
)


def _relation_report(spark: SparkSession, d: str) -> DataFrame:
    v = Validator('{"$$$$": "${q} / (${n} - 2) >= ${none:3} && ${s} > 0"}')
    out = v.report(table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{LINE} AS json"), "json")
    return out.select("l_orderkey", "l_linenumber", "ok", *[F.get_json_object("error", f"$['$$$$'].{k}").alias(n) for k, n in (("error", "why"), ("interim[0]", "interim"))])


_r = f"({_N} <> 2 AND {_Q} // nullif(abs({_N} - 2), 0) * sign({_N} - 2) >= 3 AND l_suppkey > 0)"
add(
    "rel_report",
    _relation_report,
    f"SELECT l_orderkey, l_linenumber, {_r} AS ok, CASE WHEN {_N} = 2 THEN 'divide by zero :: (${{n:_}} - 2)' END AS why, CASE WHEN {_N} <> 2 AND NOT {_r} THEN '(((' || {_Q} || ' / (' || {_N} || ' - 2)) >= _:3) && (' || l_suppkey || ' > 0))' END AS interim FROM lineitem",
)

# -- strings and times


def _strings(*cols):
    return lambda spark, d: table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[make().alias(n) for n, make in cols])


add("str_interpolate", _strings(("r", lambda: strings.interpolate(F.concat(F.lit("${a.b}/${zz}/${c}-"), F.col("p_size").cast("string")), {"a.b": F.col("p_brand"), "c": F.concat(F.lit("$1${a.b}"), F.col("p_type"))}))), "SELECT p_partkey AS id, p_brand || '//$1${a.b}' || p_type || '-' || p_size AS r FROM part")
add("str_interpolate2", _strings(("r", lambda: F.array_join(strings.interpolate_each("p", "q", F.array("p_brand", F.col("p_size").cast("string")), F.concat(F.lit("<${p[q]}|${p[r]}|${p}>"), "p_name")), ","))), "SELECT p_partkey AS id, '<' || p_brand || '||${p}>' || p_name || ',<' || p_size || '||${p}>' || p_name AS r FROM part")
add("str_unescape", _strings(("r", lambda: strings.unescape(F.concat(F.lit(r"a\tb\\"), "p_brand", F.lit(r"\uu00e9\"😀")))), ("bad", lambda: strings.unescape(F.concat(F.lit("\\"), F.substring("p_brand", 1, 1))))), "SELECT p_partkey AS id, 'a' || chr(9) || 'b\\' || p_brand || 'é\"😀' AS r, CASE WHEN substring(p_brand, 1, 1) = 'b' THEN chr(8) END AS bad FROM part")
add("str_unescape_unicode", _strings(("r", lambda: strings.unescape_unicode(F.concat("p_brand", F.lit(r"A\n"), F.lpad(F.hex("p_size"), 4, "0"))))), "SELECT p_partkey AS id, p_brand || 'A\\n' || lpad(hex(p_size), 4, '0') AS r FROM part")
add("str_has_key", _strings(("hit", lambda: strings.has_key(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("x ${"), F.col("p_size").cast("string"), F.lit("}"))).otherwise(F.lit("${}"))))), "SELECT p_partkey AS id, p_size % 2 = 0 AS hit FROM part")
add("str_lift", _strings(("r", lambda: strings.lift(F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.col("p_brand"))))), "SELECT p_partkey AS id, CASE WHEN p_size % 2 <> 0 THEN p_brand END AS r FROM part")
add("time_string", lambda spark, d: table(spark, d, "orders").select("o_orderkey", strings.date_time(F.col("o_orderdate")).alias("at")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' 000' AS at FROM orders")


def _time_log(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 1000 / 8)").alias("done"))
    return strings.time_log(rows, "o_orderdate", "done").select("o_orderkey", strings.elapsed(F.col("o_orderdate"), F.col("done")).alias("ms"), F.substring_index("log", " elapsed ", 1).alias("log"))


_done = "(o_orderdate + to_milliseconds(o_orderkey % 1000 * 125))"
add("time_log", _time_log, f"SELECT o_orderkey, o_orderkey % 1000 * 125 AS ms, 'timeLog :: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' 000 ' || strftime({_done}, '%Y-%m-%d %H:%M:%S %g') AS log FROM orders")

# -- SQL functions


def _sql(define, query: str, source: tuple | None = EVENT):
    def run(spark, d):
        (table(spark, d, "documents") if source is None else documents_of(spark, d, source)).createOrReplaceTempView("rulespark_rows")
        define(spark)
        return spark.sql(query)

    return run


RULES = {1: "'the' & 'of'", 2: "'license' ~ 'version'", 3: "* & !'e'"}
_rules = f"SELECT doc_id, 1 AS rule_id, '(the & of)' AS rule FROM documents WHERE {has('the')} AND {has('of')} UNION ALL SELECT doc_id, 2, '(license ~ version)' FROM documents WHERE {seq('license', 'version')} UNION ALL SELECT doc_id, 3, '(* & !e)' FROM documents WHERE NOT {has('e')}"
add("sql_classify", _sql(lambda s: sql.register_classifier(s, "rulespark_classify", Classifier(RULES)), "SELECT doc_id, array_contains(rulespark_classify(text), 1) AS a, size(rulespark_classify(text)) AS n FROM rulespark_rows", None), f"SELECT doc_id, bool_or(coalesce(rule_id = 1, false)) AS a, CAST(count(rule_id) AS INTEGER) AS n FROM documents LEFT JOIN ({_rules}) USING (doc_id) GROUP BY doc_id")
add("sql_hits", _sql(lambda s: sql.register_hits(s, "rulespark_hits", Classifier(RULES)), "SELECT doc_id, h.rule_id, h.rule FROM rulespark_rows, LATERAL rulespark_hits(text) h", None), _rules)
add("sql_validate", _sql(lambda s: sql.register_validator(s, "rulespark_validate", Validator('{"k": "gt(50)", "$$$$": "${k} * 2 < 180"}')), "SELECT id, rulespark_validate(json).ok AS ok, get_json_object(rulespark_validate(json).error, '$.k.value') AS low FROM rulespark_rows WHERE id % 2 = 0"), f"SELECT event_id AS id, {K} > 50 AND {K} < 90 AS ok, CASE WHEN {K} <= 50 THEN CAST({K} AS VARCHAR) END AS low FROM events WHERE event_id % 2 = 0")
add("sql_checks", _sql(lambda s: sql.register_checks(s, "rulespark_checks", Validator('{"k": "lt(20)", "_?_:x": "_any"}')), "SELECT id, rulespark_checks(json)[0].path AS path FROM rulespark_rows WHERE size(rulespark_checks(json)) > 0"), f"SELECT event_id AS id, '$.k' AS path FROM events WHERE {K} >= 20")
add("sql_convert", _sql(lambda s: sql.register_converter(s, "rulespark_convert", Converter('{"{$$}": "$", "{$>}": {"n": "$.name::toLower()", "deep": {"s": "$.seg"}}}')), "SELECT id, get_json_object(rulespark_convert(json).value, '$.n') AS n, get_json_object(rulespark_convert(json).value, '$.deep.s') AS s FROM rulespark_rows", CUSTOMER), "SELECT c_custkey AS id, lower(c_name) AS n, c_mktsegment AS s FROM customer")
add("sql_json_path", _sql(lambda s: sql.register_path(s, "rulespark_path", "$..[?(@ > 5000)]"), "SELECT id, CAST(size(rulespark_path(json)) AS BIGINT) AS n FROM rulespark_rows", CUSTOMER), "SELECT c_custkey AS id, CAST(c_acctbal > 5000 AS BIGINT) AS n FROM customer")

# -- compile errors and printed rules as data


def _rules_as_rows(spark: SparkSession, d: str) -> DataFrame:
    rule = F.expr("""CASE p_size % 4 WHEN 0 THEN concat('{"w": "gt(', p_size, ') && zz', p_size, '(1)", "b": ["_any"], "c": [{"d": "_length(', p_brand, ')"}]}')
        WHEN 1 THEN concat('{"$$$$": "', chr(36), '{q} >", "w": "lt(', p_size, ') &&"}') WHEN 2 THEN concat('"', p_brand, '"') ELSE concat('{"w": "gt(', p_size, ')"} ### ', p_brand) END""")
    out = check_rules(table(spark, d, "part").select(F.col("p_partkey").alias("id"), rule.alias("rule")), "rule")
    return out.select("id", "ok", F.explode_outer("faults").alias("f")).select("id", "ok", "f.path", "f.kind", "f.detail")


add(
    "val_syntax_errors",
    _rules_as_rows,
    """SELECT p_partkey AS id, false AS ok, '$.w' AS path, 'value' AS kind, 'unknown-function:: zz' || p_size || '(1)' AS detail FROM part WHERE p_size % 4 = 0
    UNION ALL SELECT p_partkey, false, '$.b', 'node', 'not Object/Array: _any' FROM part WHERE p_size % 4 = 0
    UNION ALL SELECT p_partkey, false, '$.c[].d', 'value', 'type error(' || p_brand || ' is not long):: _length(' || p_brand || ')' FROM part WHERE p_size % 4 = 0
    UNION ALL SELECT p_partkey, false, '$.$$$$', 'object', 'syntax error :: ${q} >' FROM part WHERE p_size % 4 = 1
    UNION ALL SELECT p_partkey, false, '$.w', 'syntax', 'syntax error :: lt(' || p_size || ') &&' FROM part WHERE p_size % 4 = 1
    UNION ALL SELECT p_partkey, false, '$', 'node', 'not Object/Array: ' || p_brand FROM part WHERE p_size % 4 = 2
    UNION ALL SELECT p_partkey, true, NULL, NULL, NULL FROM part WHERE p_size % 4 = 3""",
)


def _templates_as_rows(spark: SparkSession, d: str) -> DataFrame:
    template = F.expr("""CASE p_size % 3 WHEN 0 THEN concat('{"{$$}" : "$", "{$>}" : {"a": "$.x[ ', p_size, ' ]::toLongOr( ', p_size, ' )", "b": "\\\\\\\\$', p_size, '"}}')
        WHEN 1 THEN concat('{"[$$]": "$.l[*]", "[$>]": {"n": [', p_size, '], "m": "$.m"}}') ELSE concat('{"{$$}": "$", "{$>}": {"a": "$.x::none', p_size, '()"}}') END""")
    return check_templates(table(spark, d, "part").select(F.col("p_partkey").alias("id"), template.alias("t")), "t").select("id", "ok", "source", "errors")


add(
    "conv_template_source",
    _templates_as_rows,
    r"""SELECT p_partkey AS id, p_size % 3 = 0 AS ok, CASE WHEN p_size % 3 = 0 THEN '{"{$$}":"$","{$>}":{"a":"$.x[' || p_size || ']::toLongOr(' || p_size || ')","b":"\\$' || p_size || '"}}' END AS source,
    CASE p_size % 3 WHEN 1 THEN '{"[$>]":{"n":"an array is not allowed here"}}' WHEN 2 THEN '{"{$>}":{"a":"unknown function :: none' || p_size || '"}}' END AS errors FROM part""",
)
add(
    "path_source",
    lambda spark, d: printed_paths(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat('$ .', 'a') AS no"), F.expr("concat('$[\"x y\"]..b[ ', p_size, ' , 2 ][?( @.n==', p_size, ' )].', chr(39), p_brand, chr(39))").alias("p")), "p").select("id", "printed"),
    "SELECT p_partkey AS id, '$.''x y''..b[' || p_size || ',2][?(@.n == ' || p_size || ')].' || p_brand AS printed FROM part",
)

# -- functions of one's own, sources and sinks


def _own_predicate(spark: SparkSession, d: str) -> DataFrame:
    predicate.register("_even", predicate.Predicate("string", 0, lambda v, a, _: F.try_variant_get(v, "$", "bigint") % 2 == 0, lambda v, a, _: isinstance(v, int) and v % 2 == 0))
    try:
        return Validator('{"k": "_even && gt(10)"}').transform(documents_of(spark, d, EVENT), "json").select("id", "ok")
    finally:
        del predicate.PREDICATES["_even"]


add("val_registered_predicate", _own_predicate, f"SELECT event_id AS id, {K} % 2 = 0 AND {K} > 10 AS ok FROM events")


def _own_function(spark: SparkSession, d: str) -> DataFrame:
    values.register("mirror", (str,), lambda v, sep: sep.join([v, v[::-1]]))
    try:
        c = Converter('{"{$$}": "$", "{$>}": {"r": "$.brand::toLower().mirror(\'-\')"}}')
    finally:
        del values.FUNCTIONS["mirror"]
    return c.transform(documents_of(spark, d, PART), "json").select("id", "ok", F.get_json_object("value", "$.r").alias("r"))


add("fn_registered_function", _own_function, "SELECT p_partkey AS id, true AS ok, lower(p_brand) || '-' || reverse(lower(p_brand)) AS r FROM part")
add("val_rule_comments", lambda spark, d: Validator('{### one rule\n "k": "gt(50)" ### and no more\n}').transform(documents_of(spark, d, EVENT), "json").select("id", "ok"), f"SELECT event_id AS id, {K} > 50 AS ok FROM events")


@F.pandas_udf(BinaryType())
def _gzipped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else gzip.compress(t.encode(), 1))


add("src_gunzip", lambda spark, d: table(spark, d, "documents").select("doc_id", F.sha2(gunzip(_gzipped("text")).cast("binary"), 256).alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents")
add("src_pretty", lambda spark, d: table(spark, d, "events").select("event_id", pretty(F.from_json("props", "k bigint")).alias("text")), f"SELECT event_id, '{{' || chr(10) || '  \"k\" : ' || {K} || chr(10) || '}}' AS text FROM events")

"""Validation of JSON documents: structure, values and relations between fields.

A rule is JSON shaped like its target: objects of fields (prefix `_?_:` for optional ones, `$$$$` for a relation), arrays of one
element rule, and value rules as leaves; `###` starts a comment. A relation is one expression or an array of several. The rule compiles to Columns over one
parsed VARIANT: `transform` adds ok and a flat array of errors, `report` the pruned document and the nested error tree as JSON texts, folded
upward from the leaves (`outcome`). `report_trees` runs the same rule on trees in Arrow batches; there copied objects keep the
document's order, numbers stay as they stand, and of repeated keys the first is read. as_float: relations are over doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cursor import RuleError
from ..functions.jsonvalue import MISSING, Obj, dump, parse, scalar_text
from ..functions.outcome import TOLD, bound, braces, brackets, either, elements, literal, members, outcome, over_documents, quoted
from ..functions.predicate import ValueRule, kind_of
from ..functions.relation import EvaluationError, Relation, variant_path

RELATION, OPTIONAL = "$$$$", "_?_:"
ERRORS = "array<struct<path:string,type:string,detail:string>>"
# Kinds of failure.
FALSE, NO_KEY, NO_TYPE, REL_FALSE, REL_ERROR = "Evaluated Result is false", "Key does not exist", "Type Mismatch", "Object-Evaluation result is false", "Object-Evaluation Error"


def strip_comments(text: str, mark: str = "###", line: str = "\n") -> str:
    return line.join(part.split(mark)[0] for part in text.split(line))


def error(path: Column, kind: str, detail) -> Column:
    return F.struct(path.alias("path"), F.lit(kind).alias("type"), (detail if isinstance(detail, Column) else F.lit(detail)).cast("string").alias("detail"))



def none() -> Column:
    return F.array().cast(ERRORS)


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def mismatch(v: Column, what: str) -> Column:
    return braces(members([("type", literal(NO_TYPE)), ("value", F.to_json(v)), ("error", literal(what))]))


@dataclass
class Leaf:
    rule: ValueRule

    def outcome(self, v: Column) -> Column:
        shown = quoted(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null")))
        false = braces(members([("type", literal(FALSE)), ("value", shown), ("result", literal(self.rule.text))]))
        return F.when(is_array(v) | is_object(v), outcome(None, mismatch(v, "must be JValue"))).when(~self.rule.column(v), outcome(None, false)).otherwise(outcome(F.to_json(v), None))

    def errors(self, v: Column, path: Column) -> Column:
        nested = is_array(v) | is_object(v)
        shown = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null"))
        return F.when(nested, F.array(error(path, NO_TYPE, "must be JValue"))).when(~self.rule.column(v), F.array(error(path, FALSE, shown))).otherwise(none())

    def check(self, v):
        """(value, None) or (None, error)."""
        if isinstance(v, list):
            return None, Obj([("type", NO_TYPE), ("value", v), ("error", "must be JValue")])
        if not self.rule.test(v):
            return None, Obj([("type", FALSE), ("value", scalar_text(v)), ("result", self.rule.text)])
        return (v,), None


@dataclass
class Items:
    node: object

    def errors(self, v: Column, path: Column) -> Column:
        at = F.concat(path, F.lit("[]"))
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: self.node.errors(x, at))
        return F.when(~is_array(v), F.array(error(path, NO_TYPE, "must be JArray"))).otherwise(F.coalesce(F.flatten(each), none()))

    def outcome(self, v: Column) -> Column:
        each = elements(F.try_variant_get(v, "$", "array<variant>"), self.node.outcome)
        return F.when(~is_array(v), outcome(None, mismatch(v, "must be JArray"))).otherwise(each)

    def check(self, v):
        if not isinstance(v, list) or isinstance(v, Obj):
            return None, Obj([("type", NO_TYPE), ("value", v), ("error", "must be JArray")])
        got = [self.node.check(x) for x in v]
        bad = [e for _, e in got if e is not None]
        return (None, bad) if bad else (([g[0] for g, _ in got],), None)


def _there_or(node, absent: Column):
    return lambda x: F.when(x.isNull(), absent).otherwise(node.outcome(x))


@dataclass
class Fields:
    fields: list[tuple[str, bool, object]]
    relation: Relation | None

    def errors(self, v: Column, path: Column) -> Column:
        parts = []
        if self.relation is not None:
            here = F.concat(path, F.lit("." + RELATION))
            outcomes = F.array(none(), F.array(error(here, REL_FALSE, self.relation.text)), F.array(error(here, REL_ERROR, self.relation.text)))
            parts.append(F.get(outcomes, self.relation.outcome(v)))
        for key, optional, node in self.fields:
            x, at = F.try_variant_get(v, variant_path([key]), "variant"), F.concat(path, F.lit("." + key))
            absent = none() if optional else F.array(error(at, NO_KEY, f"Key({key}) must exist."))
            parts.append(F.when(x.isNull(), absent).otherwise(node.errors(x, at)))
        whole = F.concat(*parts) if parts else none()
        return F.when(~is_object(v), F.array(error(path, NO_TYPE, "must be JObject"))).otherwise(whole)

    def outcome(self, v: Column) -> Column:
        """The object of its fields' outcomes; an optional field that isn't there is null."""
        parts = []
        for key, optional, node in self.fields:
            absent = outcome(F.lit("null"), None) if optional else outcome(None, literal(Obj([("type", NO_KEY), ("error", f"Key({key}) must exist.")])))
            parts.append((key, bound(F.try_variant_get(v, variant_path([key]), "variant"), _there_or(node, absent))))
        related = F.lit(None).cast("string") if self.relation is None else self._related(v)

        def use(s: Column) -> Column:
            got = [(k, s[f"f{i}"]) for i, (k, _) in enumerate(parts)]
            failed = F.coalesce(s["r"], *[x["error"] for _, x in got])
            return either(braces(members([(k, x["value"]) for k, x in got])), F.when(failed.isNotNull(), braces(members([(RELATION, s["r"]), *((k, x["error"]) for k, x in got)]))))

        whole = bound(F.struct(related.alias("r"), *[x.alias(f"f{i}") for i, (_, x) in enumerate(parts)]), use)
        return F.when(~is_object(v), outcome(None, mismatch(v, "must be JObject"))).otherwise(whole)

    def _related(self, v: Column) -> Column:
        def error(reasons: Column) -> Column:
            said = quoted(F.get(reasons, F.lit(0))) if len(self.relation.trees) == 1 else brackets(F.transform(reasons, quoted))
            return braces(members([("type", literal(REL_ERROR)), ("error", said)]))

        def false(shown: Column) -> Column:
            return braces(members([("type", literal(REL_FALSE)), ("expression", literal(str(self.relation))), ("interim", brackets(F.transform(shown, quoted))), ("result", literal("false"))]))

        return self.relation.report(v, error, false)

    def check(self, v):
        if not isinstance(v, Obj):
            return None, Obj([("type", NO_TYPE), ("value", v), ("error", "must be JObject")])
        out, bad = Obj(), Obj()
        if self.relation is not None:
            try:
                if not self.relation.test(v):
                    shown = [self.relation.interim(v, t) for t in self.relation.trees]
                    bad.append((RELATION, Obj([("type", REL_FALSE), ("expression", str(self.relation)), ("interim", shown), ("result", "false")])))
            except EvaluationError as e:
                bad.append((RELATION, Obj([("type", REL_ERROR), ("error", str(e) if len(self.relation.trees) == 1 else list(e.args))])))
        for key, optional, node in self.fields:
            x = v.get(key, MISSING)
            if x is MISSING:
                if optional:
                    out.append((key, None))
                else:
                    bad.append((key, Obj([("type", NO_KEY), ("error", f"Key({key}) must exist.")])))
                continue
            got, e = node.check(x)
            if e is None:
                out.append((key, got[0]))
            else:
                bad.append((key, e))
        return (None, bad) if bad else ((out,), None)


def compile_node(rule, documented: bool = False, as_float: bool = False):
    """A node, or a RuleError that has the errors of all parts."""
    if isinstance(rule, str):
        return Leaf(ValueRule(rule, documented))
    if isinstance(rule, Obj):
        fields, bad, relation = [], [], None
        for key, sub in rule:
            optional = key.startswith(OPTIONAL)
            name = key[len(OPTIONAL) :] if optional else key
            try:
                if key != RELATION:
                    fields.append((name, optional, compile_node(sub, documented, as_float)))
                elif sum(k == RELATION for k, _ in rule) == 1 and (isinstance(sub, str) or _texts(sub)):
                    relation = Relation(sub, as_float)
            except RuleError as e:
                bad.append((name, e))
        if bad:
            raise RuleError(Obj((k, e.tree) for k, e in bad), "fields", bad)
        return Fields(fields, relation)
    if isinstance(rule, list):
        if len(rule) != 1:
            raise RuleError(f"Array must have a single-element :: 1 != {len(rule)}", "node")
        if not isinstance(rule[0], list):
            raise RuleError(f"not Object/Array: {scalar_text(rule[0])}", "node")
        try:
            return Items(compile_node(rule[0], documented, as_float))
        except RuleError as e:
            raise RuleError([e.tree], "items", [("[]", e)]) from None
    raise RuleError(f"not String/Object/Array:: {scalar_text(rule)}", "node")


def _texts(x) -> bool:
    return isinstance(x, list) and not isinstance(x, Obj) and bool(x) and all(isinstance(t, str) for t in x)


def check_rules(df: DataFrame, rule_col: str) -> DataFrame:
    """df, whose rows hold rules as texts, with ok, the tree of all their syntax errors as JSON, and these as a flat array of
    (path, kind, detail). A null rule is no JSON."""
    at = df.columns.index(rule_col)
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("path", "kind", "detail")]))

    def one(text: str | None) -> tuple[bool, str | None, list[dict]]:
        try:
            Validator(text or "")
        except RuleError as e:
            return False, dump(e.tree), [{"path": p, "kind": k, "detail": d} for p, k, d in e.faults()]
        return True, None, []

    def work(batches):
        for batch in batches:
            rows = [one(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.bool_(), pa.string(), kind))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "ok", "tree", "faults"])

    return df.mapInArrow(work, ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), "ok boolean", "tree string", "faults array<struct<path:string,kind:string,detail:string>>"]))


class Validator:
    def __init__(self, rule: str, semantics: str = "reference", as_float: bool = False):
        try:
            tree = parse(strip_comments(rule))
        except ValueError:
            raise RuleError("Invalid JSON string", "json") from None
        if not isinstance(tree, list):
            raise RuleError(f"not Object/Array: {scalar_text(tree)}", "node")
        self.node = compile_node(tree, semantics == "documented", as_float)

    def errors(self, variant: Column) -> Column:
        return F.when(variant.isNull(), F.array(error(F.lit("$"), "Invalid JSON", "not valid json"))).otherwise(self.node.errors(variant, F.lit("$")))

    def transform(self, df: DataFrame, json_col: str, ok: str = "ok", errors: str = "errors") -> DataFrame:
        """df with ok and errors (path, type, detail); the document is parsed once."""
        return over_documents(df, json_col, self.errors, {errors: lambda e: e, ok: lambda e: F.size(e) == 0})

    def validate(self, text: str | None) -> tuple[bool, str | None, str | None]:
        """(ok, pruned document, error tree) of one document."""
        try:
            doc = parse(text if text is not None else "")
        except ValueError:
            return False, None, '"not valid json"'
        got, e = self.node.check(doc)
        return (True, dump(got[0]), None) if e is None else (False, None, dump(e))

    def outcome(self, variant: Column) -> Column:
        """A struct of the pruned document and the error tree, JSON texts, of which one is NULL."""
        return F.when(variant.isNull(), outcome(None, literal("not valid json"))).otherwise(self.node.outcome(variant))

    def report(self, df: DataFrame, json_col: str) -> DataFrame:
        """df with ok, value and error as JSON texts."""
        return over_documents(df, json_col, self.outcome, TOLD)

    def report_trees(self, df: DataFrame, json_col: str) -> DataFrame:
        """The same on parsed trees in Arrow batches."""
        return in_batches(df, json_col, self.validate, [("ok", "boolean"), ("value", "string"), ("error", "string")])


def in_batches(df: DataFrame, col: str, run, outs: list[tuple[str, str]]) -> DataFrame:
    """df with the results of run on a text column, computed in Arrow batches."""
    at = df.columns.index(col)
    kinds = {"boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}

    def work(batches):
        for batch in batches:
            rows = [run(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(outs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _ in outs)])

    return df.mapInArrow(work, ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), *(f"`{n}` {k}" for n, k in outs)]))

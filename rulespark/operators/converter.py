"""Conversion of JSON documents by a template.

A template has a root pair (`[$$]` path and `[$>]` body: an array of one object per match; `{$$}` and `{$>}`: one object), and bodies of fields:
paths (`$...`, with functions), literals, nested objects, merges (`{::}` and `{=>}`) and sub-arrays (`[::]` and `[=>]`). Any failing
field fails the document, and the failures come back as a tree under the fields' names.

`transform` compiles the template to one nested Column over a VARIANT (`outcome`): each part is a value or a failure, both JSON texts, and
failures are gathered upward. The text is parsed once and nothing is shuffled. Within what is copied whole, a VARIANT has an object's keys
in order of name and numbers without zeros at their ends; `transform_trees` keeps both as they stand, in Arrow batches, and takes templates whose functions
have no Column form. `columns` gives flat templates of single paths as typed Columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonpath
from ..functions.cursor import RuleError
from ..functions.jsonpath import Path, column, columns, find
from ..functions.jsonvalue import Obj, dump, parse, pretty, scalar_text
from ..functions.outcome import TOLD, bound, braces, either, elements, fields, literal, members, outcome, over_documents, quoted
from ..functions.predicate import is_text
from ..functions.values import ALIASES, COLUMNS, GIVES, TAKES, chain_outcome, compile_chain, has_columns, run_chain, shown
from .validator import in_batches

# Reserved keys.
ROOT_ARRAY, ROOT_OBJECT, SUB_ARRAY, MERGE = ("[$$]", "[$>]"), ("{$$}", "{$>}"), ("[::]", "[=>]"), ("{::}", "{=>}")
RESERVED = {*ROOT_ARRAY, *ROOT_OBJECT, *SUB_ARRAY, *MERGE}


class Denied(Exception):
    """Why a part could not be built: a text, a list, or an Obj by field."""

    def __init__(self, tree):
        super().__init__(dump(tree))
        self.tree = tree


def _path(text, functions: bool, documented: bool):
    if not isinstance(text, str) or text[:1] not in ("$", "@"):
        raise RuleError(f"a path starts with $ or @ :: {scalar_text(text)}")
    if not functions:
        return jsonpath.parse_path(text)
    path, calls = jsonpath.parse_with_functions(text)
    return path, calls, compile_chain(calls, documented)


@dataclass
class Value:
    text: str
    path: Path
    calls: tuple
    chain: list
    documented: bool = False

    def build(self, root, current):
        found = find(self.path, root, current)
        if not found:
            raise Denied(f"{self.text}: not found")
        if len(found) > 1:
            raise Denied(f"{self.text}: too many({len(found)})[{','.join(map(scalar_text, found))}]")
        try:
            return run_chain(self.chain, found[0])
        except ValueError as e:
            raise Denied(f"{self.text}: manipulate fail : {e}") from None

    def outcome(self, root: Column, current: Column) -> Column:
        def use(found: Column) -> Column:
            all_ = F.concat(F.lit(f"{self.text}: too many("), F.size(found).cast("string"), F.lit(")["), F.array_join(F.transform(found, shown), ","), F.lit("]"))
            one = chain_outcome(self.calls, F.get(found, F.lit(0)), f"{self.text}: manipulate fail : ", self.documented)
            return F.when(F.size(found) == 1, one).otherwise(outcome(None, F.when(F.size(found) == 0, literal(f"{self.text}: not found")).otherwise(quoted(all_))))

        return bound(columns(self.path, current, root), use)

    def native(self) -> bool:
        return has_columns(self.calls)

    def source(self) -> str:
        return jsonpath.source_with_functions(self.path, self.calls)


@dataclass
class Constant:
    value: object

    def build(self, root, current):
        return self.value

    def outcome(self, root: Column, current: Column) -> Column:
        return outcome(literal(self.value), None)

    def native(self) -> bool:
        return True

    def source(self):
        return "\\" + self.value if isinstance(self.value, str) and self.value[:1] in ("$", "@", "\\") else self.value


@dataclass
class Body:
    fields: list
    merge: tuple | None  # (text, path, body)

    def build(self, root, current) -> Obj:
        out, bad = Obj(), Obj()
        if self.merge is not None:
            text, path, body = self.merge
            found = find(path, root, current)
            try:
                if len(found) != 1:
                    raise Denied(f"{text} : 0 -> empty" if not found else f"{text} : too many({len(found)})")
                out += body.build(root, found[0])
            except Denied as e:
                bad.append((MERGE[1], e.tree))
        for key, node in self.fields:
            try:
                out.append((key, node.build(root, current)))
            except Denied as e:
                bad.append((key, e.tree))
        if bad:
            raise Denied(bad)
        return out

    def outcome(self, root: Column, current: Column) -> Column:
        own = [(key, node.outcome(root, current)) for key, node in self.fields]
        if self.merge is None:
            return fields(own)
        text, path, body = self.merge

        def merged(found: Column) -> Column:
            n = F.size(found)
            why = F.when(n == 0, literal(f"{text} : 0 -> empty")).otherwise(quoted(F.concat(F.lit(f"{text} : too many("), n.cast("string"), F.lit(")"))))
            return F.when(n == 1, body.outcome(root, F.get(found, F.lit(0)))).otherwise(outcome(None, why))

        def use(s: Column) -> Column:
            got = [(k, s[f"f{i}"]) for i, (k, _) in enumerate(own)]
            failed = F.coalesce(s["m"]["error"], *[x["error"] for _, x in got])
            within = F.nullif(F.substring(s["m"]["value"], F.lit(2), F.length(s["m"]["value"]) - 2), F.lit(""))
            value = F.concat_ws(",", within, *[F.concat(F.lit(dump(k) + ":"), x["value"]) for k, x in got])
            return either(braces(value), F.when(failed.isNotNull(), braces(members([(MERGE[1], s["m"]["error"]), *((k, x["error"]) for k, x in got)]))))

        return bound(F.struct(bound(columns(path, current, root), merged).alias("m"), *[x.alias(f"f{i}") for i, (_, x) in enumerate(own)]), use)

    def native(self) -> bool:
        return all(node.native() for _, node in self.fields) and (self.merge is None or self.merge[2].native())

    def source(self) -> Obj:
        merge = [] if self.merge is None else [(MERGE[0], jsonpath.source(self.merge[1])), (MERGE[1], self.merge[2].source())]
        return Obj([*merge, *((k, node.source()) for k, node in self.fields)])


@dataclass
class Items:
    text: str
    path: Path
    body: Body

    def build(self, root, current) -> list:
        return _each(find(self.path, root, current), lambda x: self.body.build(root, x), SUB_ARRAY[1])

    def outcome(self, root: Column, current: Column) -> Column:
        return elements(columns(self.path, current, root), lambda x: self.body.outcome(root, x), lambda e: braces(members([(SUB_ARRAY[1], e)])))

    def native(self) -> bool:
        return self.body.native()

    def source(self) -> Obj:
        return Obj([(SUB_ARRAY[0], jsonpath.source(self.path)), (SUB_ARRAY[1], self.body.source())])


def _each(nodes: list, make, key: str) -> list:
    out, bad = [], []
    for x in nodes:
        try:
            out.append(make(x))
        except Denied as e:
            bad.append(e.tree)
    if bad:
        raise Denied(Obj([(key, bad)]))
    return out


def _pair(rule: Obj, keys: tuple[str, str]):
    """(path text, body) of a pair of keys, None if neither is there."""
    path, body = (rule.get(k) for k in keys)
    there = [any(k == name for k, _ in rule) for name in keys]
    if not any(there):
        return None
    if not all(there) or not isinstance(path, str) or not isinstance(body, Obj):
        raise RuleError(f"pair-key not exist :: {keys[0]} {keys[1]}")
    return path, body


class Converter:
    def __init__(self, template: str, semantics: str = "reference"):
        self.documented = semantics == "documented"
        try:
            rule = parse(template)
        except ValueError:
            raise RuleError("not valid json") from None
        if not isinstance(rule, Obj):
            raise RuleError("a template is an object")
        pairs = [(k, p) for k, p in ((k, _pair(rule, k)) for k in (ROOT_ARRAY, ROOT_OBJECT)) if p]
        if len(pairs) != 1:
            raise RuleError("a template has one root pair, [$$] and [$>] or {$$} and {$>}")
        (self.kind, (self.text, body)) = pairs[0]
        bad = Obj()
        for key, make in ((self.kind[0], lambda: setattr(self, "path", _path(self.text, False, self.documented))), (self.kind[1], lambda: setattr(self, "body", self._body(body)))):
            try:
                make()
            except RuleError as e:
                bad.append((key, e.tree))
        if bad:
            raise RuleError(bad)

    def _node(self, rule):
        if isinstance(rule, Obj):
            pair = _pair(rule, SUB_ARRAY)
            if pair is None:
                return self._body(rule)
            if others := [k for k, _ in rule if k not in RESERVED]:
                raise RuleError(f"{SUB_ARRAY[0]} allows no other fields :: {','.join(others)}")
            return Items(pair[0], _path(pair[0], False, self.documented), self._body(pair[1]))
        if isinstance(rule, list):
            raise RuleError("an array is not allowed here")
        if isinstance(rule, str) and rule[:1] in ("$", "@"):
            return Value(rule, *_path(rule, True, self.documented), self.documented)
        return Constant(rule[1:] if isinstance(rule, str) and rule[:1] == "\\" else rule)

    def _body(self, rule: Obj) -> Body:
        fields, bad, merge = [], Obj(), None
        try:
            if pair := _pair(rule, MERGE):
                merge = (pair[0], _path(pair[0], False, self.documented), self._body(pair[1]))
        except RuleError as e:
            bad.append((MERGE[1], e.tree))
        for key, sub in rule:
            if key in RESERVED:
                continue
            try:
                fields.append((key, self._node(sub)))
            except RuleError as e:
                bad.append((key, e.tree))
        if bad:
            raise RuleError(bad)
        return Body(fields, merge)

    def convert(self, text: str | None) -> tuple[bool, str | None, str | None]:
        """(ok, result, error) of one document, as JSON texts."""
        try:
            doc = parse(text if text is not None else "")
        except ValueError:
            return False, None, '"not valid json"'
        found = find(self.path, doc, doc)
        try:
            if self.kind == ROOT_ARRAY:
                out, bad = [], []
                for x in found:
                    try:
                        out.append(self.body.build(x, x))
                    except Denied as e:
                        bad.append(e.tree)
                if bad or not out:
                    raise Denied(Obj([*([] if out else [(ROOT_ARRAY[0], f"{self.text} : {len(found)} -> empty")]), *([(ROOT_ARRAY[1], bad)] if bad else [])]))
            elif len(found) == 1:
                out = self.body.build(found[0], found[0])
            else:
                raise Denied(f"{ROOT_OBJECT[0]} : empty " if not found else f"{ROOT_OBJECT[0]} : too many({len(found)})")
        except Denied as e:
            return False, None, dump(e.tree)
        return True, dump(out), None

    def source(self) -> str:
        """The compiled template as JSON, paths in one form; it compiles to the same template."""
        return dump(self._tree())

    def pretty(self) -> str:
        """The same, a member a line."""
        return pretty(self._tree())

    def _tree(self) -> Obj:
        return Obj([(self.kind[0], jsonpath.source(self.path)), (self.kind[1], self.body.source())])

    def outcome(self, variant: Column) -> Column | None:
        """The whole template as one Column, a struct of a value and an error as JSON texts; None if a function has no Column form."""
        if not self.body.native():
            return None

        def use(found: Column) -> Column:
            n = F.size(found)
            if self.kind == ROOT_OBJECT:
                why = F.when(n == 0, literal(f"{ROOT_OBJECT[0]} : empty ")).otherwise(quoted(F.concat(F.lit(f"{ROOT_OBJECT[0]} : too many("), n.cast("string"), F.lit(")"))))
                one = F.get(found, F.lit(0))
                return F.when(n == 1, self.body.outcome(one, one)).otherwise(outcome(None, why))
            empty = quoted(F.concat(F.lit(f"{self.text} : "), n.cast("string"), F.lit(" -> empty")))

            def whole(got: Column) -> Column:
                bad = F.filter(F.transform(got, lambda x: x["error"]), lambda e: e.isNotNull())
                all_bad = F.size(bad) == n
                errors = F.concat(F.lit("["), F.array_join(bad, ","), F.lit("]"))
                failed = braces(members([(ROOT_ARRAY[0], F.when(all_bad, empty)), (ROOT_ARRAY[1], F.when(F.size(bad) > 0, errors))]))
                value = F.concat(F.lit("["), F.array_join(F.transform(got, lambda x: x["value"]), ","), F.lit("]"))
                return either(value, F.when((F.size(bad) > 0) | (n == 0), failed))

            return bound(F.transform(found, lambda x: self.body.outcome(x, x)), whole)

        return bound(columns(self.path, variant, variant), use)

    def transform(self, df: DataFrame, json_col: str, keep_order: bool = False) -> DataFrame:
        """df with ok, value and error; keep_order: see transform_trees."""
        if keep_order or not self.body.native():
            return self.transform_trees(df, json_col)
        return over_documents(df, json_col, lambda v: F.when(v.isNull(), outcome(None, literal("not valid json"))).otherwise(self.outcome(v)), TOLD)

    def transform_trees(self, df: DataFrame, json_col: str) -> DataFrame:
        """The same on parsed trees in Arrow batches: keys in the document's order, numbers as they stand."""
        return in_batches(df, json_col, self.convert, [("ok", "boolean"), ("value", "string"), ("error", "string")])

    def columns(self, variant: Column) -> dict[str, Column] | None:
        """The fields as Columns over the root node, NULL for a failure, or None unless the template is one object of literals and
        single paths whose functions take strings."""
        if self.kind != ROOT_OBJECT or self.body.merge is not None:
            return None
        root = column(self.path, variant)
        out: dict[str, Column] = {}
        for key, node in self.body.fields:
            if isinstance(node, Constant) and not isinstance(node.value, list):
                out[key] = F.lit(node.value)
                continue
            at = column(node.path, root, root) if isinstance(node, Value) and root is not None else None
            if at is None:
                return None
            x, kind = F.try_variant_get(at, "$", "string"), "text"
            names = [ALIASES.get(call.name, call.name) for call in node.calls]
            for name in names:
                if TAKES.get(name, "text") not in (kind, "any"):
                    return None  # the trees say what is wrong with it
                kind = GIVES.get(name, "text")
            if names and TAKES.get(names[0]) != "any":
                x = F.when(is_text(at), x)
            for name, call in zip(names, node.calls, strict=True):
                x = COLUMNS[name](x, *call.args)
            out[key] = x
        return out


def check_templates(df: DataFrame, template_col: str) -> DataFrame:
    """df, whose rows hold templates as texts, with ok, the compiled template in one form (source) and the tree of all its errors; a null
    template is no JSON."""

    def one(text: str | None) -> tuple[bool, str | None, str | None]:
        try:
            return True, Converter(text or "").source(), None
        except RuleError as e:
            return False, None, dump(e.tree)

    return in_batches(df, template_col, one, [("ok", "boolean"), ("source", "string"), ("errors", "string")])

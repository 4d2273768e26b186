"""JSON paths: selectors, filters and the value functions after `::`.

A path is a chain of selectors, each from nodes to nodes. Paths of single fields and positions compile to one variant lookup (`column`); lists of
fields and positions, slices, wildcards, filters and recursive descent compile to higher-order functions on arrays of variants (`columns`). A
VARIANT sorts an object's keys, so an object's values come by key there; a path that must keep the document's order of keys runs on
the parsed tree in Arrow batches (`find`).
"""

from __future__ import annotations

import re

import regex
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import javaregex
from .cursor import Cursor, RuleError
from .jsonvalue import MISSING, Obj, is_number, to_double, to_long
from .predicate import FRACTION, WHOLE, double_of, kind_of, long_of, sure, text_of
from .relation import variant_path

NAME = r"[^*.\[\]()=!<>:\"'\s]+"


@dataclass(frozen=True)
class Names:
    names: tuple[str, ...]

    def __str__(self):
        return "[" + ",".join(f"'{n}'" for n in self.names) + "]" if len(self.names) > 1 else "." + self.names[0]


@dataclass(frozen=True)
class Every:
    def __str__(self):
        return ".*"


@dataclass(frozen=True)
class Deep:
    name: str | None  # None for all

    def __str__(self):
        return ".." + (self.name or "*")


@dataclass(frozen=True)
class Places:
    at: tuple[int, ...]

    def __str__(self):
        return f"[{','.join(map(str, self.at))}]"


@dataclass(frozen=True)
class Slice:
    start: int | None
    end: int | None
    step: int | None

    def __str__(self):
        return "[" + ":".join("" if x is None else str(x) for x in (self.start, self.end, self.step)) + "]"


@dataclass(frozen=True)
class Filter:
    test: object
    deep: bool = False

    def __str__(self):
        return ("..*" if self.deep else "") + f"[?( {self.test} )]"


@dataclass(frozen=True)
class Path:
    root: bool
    steps: tuple

    def __str__(self):
        return ("$" if self.root else "@") + "".join(map(str, self.steps))


@dataclass(frozen=True)
class Literal:
    value: object

    def __str__(self):
        return str(self.value)


@dataclass(frozen=True)
class Test:
    sign: str  # exists, =~, a comparison, && or ||
    left: object
    right: object = None

    def __str__(self):
        return str(self.left) if self.sign == "exists" else f"({self.left} {self.sign} {self.right})"


@dataclass(frozen=True)
class Function:
    name: str
    args: tuple


# -- parsing


def parse_path(text: str) -> Path:
    c = Cursor(text)
    c.blanks()
    out = _path(c)
    c.need(c.done())
    return out


def parse_with_functions(text: str) -> tuple[Path, tuple[Function, ...]]:
    c = Cursor(text)
    c.blanks()
    path, calls = _path(c), []
    if c.word("::"):
        while True:
            name = c.match(r"\w+")
            c.need(name)
            args: list = []
            c.need(c.word("("))
            while not c.word(")"):
                c.need(not args or c.word(","))
                value = _literal(c)
                c.need(value is not None)
                args.append(value.value)
            calls.append(Function(name[0], tuple(args)))
            if not c.word("."):
                break
    c.need(c.done())
    return path, tuple(calls)


def _quoted(c: Cursor) -> str | None:
    m = c.match(r"'((?:\\.|[^'\\])*)'") or c.match(r'"((?:\\.|[^"\\])*)"')
    return re.sub(r"\\(['\"\\])", r"\1", m[1]) if m else None


def _path(c: Cursor, rooted: bool = True) -> Path:
    root = c.take("$")
    if not root:
        c.take("@")
    steps = []
    while step := _step(c):
        steps.append(step)
    return Path(root, tuple(steps))


def _step(c: Cursor):
    if c.take(".."):
        if c.text.startswith("[", c.at):
            f = _bracket(c)
            c.need(isinstance(f, Filter))
            return Filter(f.test, deep=True)
        if c.take("*"):
            return Deep(None)
        return Deep(_name(c))
    if c.take("."):
        return Every() if c.take("*") else Names((_name(c),))
    return _bracket(c) if c.text.startswith("[", c.at) else None


def _name(c: Cursor) -> str:
    q = _quoted(c)
    if q is None:
        m = c.match(NAME)
        c.need(m)
        q = m[0]
    return q


def _bracket(c: Cursor):
    c.take("[")
    c.blanks()
    if c.take("?("):
        c.blanks()
        test = _either(c) if not c.text.startswith(")", c.at) else Test("exists", Path(False, ()))
        c.blanks()
        c.need(c.take(")"))
        step = Filter(test)
    elif c.take("*"):
        step = Every()
    elif (q := _quoted(c)) is not None:
        names = [q]
        while c.word(","):
            names.append(_quoted(c))
            c.need(names[-1] is not None)
        step = Every() if names == ["*"] else Names(tuple(names))
    elif m := c.match(r"(-?\d+)?\s*:\s*(-?\d+)?\s*(?::\s*(-?\d+)?)?"):
        step = Slice(*(int(x) if x else None for x in m.groups()))
        if step.step == 0:
            raise RuleError(f"slice step 0 :: {c.text}")
    elif m := c.match(r"-?\d+(\s*,\s*-?\d+)*"):
        step = Places(tuple(map(int, m[0].split(","))))
    else:
        step = Every()
    c.blanks()
    c.need(c.take("]"))
    return step


def _either(c: Cursor):
    out = _every(c)
    while c.word("||"):
        out = Test("||", out, _every(c))
    return out


def _every(c: Cursor):
    out = _one(c)
    while c.word("&&"):
        out = Test("&&", out, _one(c))
    return out


def _one(c: Cursor):
    if c.take("("):
        c.blanks()
        out = _either(c)
        c.blanks()
        c.need(c.take(")"))
        return out
    left = _operand(c)
    c.blanks()
    if c.word("=~"):
        q = _quoted(c)
        c.need(q is not None and isinstance(left, Path))
        try:
            javaregex.compiled(q)
        except regex.error as e:
            raise RuleError(f"bad regex {q}: {e}") from None
        return Test("=~", left, q)
    sign = next((s for s in ("==", "!=", "<=", ">=", "<", ">") if c.word(s)), None)
    if sign is None:
        c.need(isinstance(left, Path))
        return Test("exists", left)
    return Test(sign, left, _operand(c))


def _operand(c: Cursor):
    value = _literal(c)
    return value if value is not None else _path(c)


def _literal(c: Cursor) -> Literal | None:
    if (q := _quoted(c)) is not None:
        return Literal(q)
    if m := c.match(r"-?\d+\.\d+"):
        return Literal(float(m[0]))
    if m := c.match(r"-?\d+"):
        return Literal(int(m[0]))
    if m := c.match(r"(true|false|null|empty)\b"):
        return Literal({"true": True, "false": False, "null": None, "empty": MISSING}[m[0]])
    return None


# -- printing: what the parser reads back to the same path


def _quote(text: str) -> str:
    return "'" + re.sub(r"(['\"\\])", r"\\\1", text) + "'"


def _name_source(name: str) -> str:
    return name if re.fullmatch(NAME, name) and "," not in name else _quote(name)


def source(t) -> str:
    """The text of a path, a step, a filter, a literal or a function."""
    if isinstance(t, Path):
        return ("$" if t.root else "@") + "".join(map(source, t.steps))
    if isinstance(t, Names):
        return "." + _name_source(t.names[0]) if len(t.names) == 1 else f"[{','.join(map(_quote, t.names))}]"
    if isinstance(t, Deep):
        return "..*" if t.name is None else ".." + _name_source(t.name)
    if isinstance(t, Filter):
        return (".." if t.deep else "") + f"[?({source(t.test)})]"
    if isinstance(t, Literal):
        words = {True: "true", False: "false", None: "null"}
        return "empty" if t.value is MISSING else words[t.value] if t.value is None or isinstance(t.value, bool) else _quote(t.value) if isinstance(t.value, str) else format(t.value, "f") if isinstance(t.value, float) else str(t.value)
    if isinstance(t, Function):
        return f"{t.name}({','.join(source(Literal(a)) for a in t.args)})"
    if isinstance(t, Test):
        if t.sign == "exists":
            return source(t.left)
        if t.sign in ("&&", "||"):
            return " ".join((f"({source(t.left)})", t.sign, f"({source(t.right)})"))
        return f"{source(t.left)} {t.sign} {_quote(t.right) if t.sign == '=~' else source(t.right)}"
    return str(t)


def source_with_functions(path: Path, calls: tuple[Function, ...]) -> str:
    return source(path) + ("::" + ".".join(map(source, calls)) if calls else "")


# -- evaluation on trees


def find(path: Path, root, current) -> list:
    nodes = [root if path.root else current]
    for step in path.steps:
        nodes = [y for x in nodes for y in _select(step, root, x)]
    return nodes


def _children(x) -> list:
    return [v for _, v in x] if isinstance(x, Obj) else x if isinstance(x, list) else []


def _below(x) -> list:
    here = _children(x)
    return here + [d for v in here for d in _below(v)]


def _named(x, name: str) -> list:
    out = []
    if isinstance(x, Obj):
        for k, v in x:
            if k == name:
                out.append(v)
            out += _named(v, name)
    elif isinstance(x, list):
        for v in x:
            out += _named(v, name)
    return out


def slice_bounds(s: Slice, size: int) -> range:
    step = 1 if s.step is None else s.step
    a = 0 if s.start is None else s.start + size if s.start < 0 else s.start
    b = size if s.end is None else s.end
    a, b = min(a, b), max(a, b)
    if step < 0:
        return range(0)
    first = a if a >= 0 else a + (-a + step - 1) // step * step
    return range(first, max(first, min(b, size)), step)


def _select(step, root, x) -> list:
    if isinstance(step, Names):
        return [v for v in (x.get(n, MISSING) for n in step.names) if v is not MISSING] if isinstance(x, Obj) else []
    if isinstance(step, Every):
        return _children(x)
    if isinstance(step, Deep):
        return _below(x) if step.name is None else _named(x, step.name)
    if isinstance(step, Filter):
        return [v for v in (_below(x) if step.deep else _children(x)) if holds(step.test, root, v)]
    if not isinstance(x, list) or isinstance(x, Obj):
        return []
    if isinstance(step, Places):
        return [x[i] for i in step.at if 0 <= i < len(x)]
    return [x[i] for i in slice_bounds(step, len(x))]


def holds(t: Test, root, x) -> bool:
    if t.sign in ("&&", "||"):
        a, b = holds(t.left, root, x), holds(t.right, root, x)
        return a and b if t.sign == "&&" else a or b
    left = _values(t.left, root, x)
    if t.sign == "exists":
        return bool(left)
    if t.sign == "=~":
        return any(isinstance(v, str) and javaregex.compiled(t.right).search(v) for v in left)
    right = _values(t.right, root, x)
    if len(left) != 1 and len(right) != 1:
        return False
    return any(compare(a, t.sign, b) for a in left for b in right)


def _values(side, root, x) -> list:
    if isinstance(side, Literal):
        return [] if side.value is MISSING else [side.value]
    return find(side, root, x)


def compare(a, sign: str, b) -> bool:
    """The left side's type decides; what can't be brought to it is false."""
    if isinstance(a, str):
        if not isinstance(b, str):
            return False
    elif is_number(a):
        try:
            b = to_double(b) if isinstance(a, float) else (int(b) if isinstance(b, int) and is_number(b) else to_long(b))
        except ValueError:
            return False
    else:
        return False
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]


# -- Columns


def column(path: Path, v: Column, root: Column | None = None) -> Column | None:
    """The one node of a path of single fields and positions, as VARIANT (NULL if missing); None for other paths."""
    route = []
    for step in path.steps:
        if isinstance(step, Names) and len(step.names) == 1:
            route.append(variant_path([step.names[0]])[1:])
        elif isinstance(step, Places) and len(step.at) == 1 and step.at[0] >= 0:
            route.append(f"[{step.at[0]}]")
        else:
            return None
    source = root if path.root and root is not None else v
    return F.try_variant_get(source, "$" + "".join(route), "variant") if route else source


def columns(path: Path, v: Column, root: Column | None = None) -> Column:
    """All nodes of a path, as ARRAY<VARIANT>. Objects give their values by key."""
    root = v if root is None else root
    nodes = F.array(root if path.root else v)
    route: list[str] = []  # single fields so far, one lookup
    for step in (*path.steps, None):
        if isinstance(step, Names) and len(step.names) == 1:
            route.append(step.names[0])
            continue
        if route:
            nodes = F.array_compact(F.transform(nodes, _at(variant_path(route))))
            route = []
        if step is None:
            break
        nodes = F.flatten(F.transform(nodes, _step_column(step, root)))
    return nodes


def _at(path: str):
    return lambda x: F.try_variant_get(x, path, "variant")


NONE = "array<variant>"


def _items(x: Column) -> Column:
    """The elements of an array; of anything else none."""
    return F.coalesce(F.try_variant_get(x, "$", NONE), F.array().cast(NONE))


def _members(x: Column) -> Column:
    """The elements of an array or the values of an object, these by key."""
    return F.coalesce(F.try_variant_get(x, "$", NONE), F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), F.array().cast(NONE))


BELOW = "array<struct<at:array<int>,name:string,v:variant>>"


def _children_column(node: Column) -> Column:
    """The children (at, name, v) of a node (at, ...): at is the places on the way, name the key in an object."""

    def child(x: Column, i: Column, name: Column) -> Column:
        return F.struct(F.concat(node["at"], F.array(i)).alias("at"), name.alias("name"), x.alias("v"))

    entries = F.map_entries(F.try_variant_get(node["v"], "$", "map<string,variant>"))
    return F.coalesce(
        F.transform(F.try_variant_get(node["v"], "$", NONE), lambda x, i: child(x, i, F.lit(None).cast("string"))),
        F.transform(entries, lambda e, i: child(e["value"], i, e["key"])),
        F.array().cast(BELOW),
    )


def _deep_column(x: Column, keep, order) -> Column:
    """What lies below x and is kept, level by level and then in order; a level less than the text has opening brackets is empty at the latest."""
    text = F.to_json(x)
    levels = F.length(text) - F.length(F.translate(text, "[{", ""))
    start = F.struct(F.array(F.struct(F.array().cast("array<int>").alias("at"), F.lit(None).cast("string").alias("name"), x.alias("v"))).alias("front"), F.array().cast(BELOW).alias("found"))

    def level(state: Column, _: Column) -> Column:
        def use(front: Column) -> Column:
            return F.struct(front.alias("front"), F.concat(state["found"], F.filter(front, keep)).alias("found"))

        below = F.flatten(F.transform(state["front"], _children_column))
        return F.when(F.size(state["front"]) == 0, state).otherwise(F.get(F.transform(F.array(below), use), F.lit(0)))

    found = F.aggregate(F.filter(F.sequence(F.lit(0), levels), lambda i: i > 0), start, level, lambda s: s["found"])
    # Keys are made once a node and sorted with the nodes' numbers, not compared by an expression.
    keys = lambda nodes: F.sort_array(F.transform(nodes, lambda n, i: F.struct(order(n).alias("key"), i.alias("i"))))
    return _bound(found, lambda nodes: F.transform(keys(nodes), lambda k: F.get(nodes, k["i"])["v"]))


def _level_order(n: Column) -> Column:
    """Children of one node stand together, before what is below them."""
    return F.struct(F.slice(n["at"], F.lit(1), F.size(n["at"]) - 1), n["at"])


def _step_column(step, root: Column):
    if isinstance(step, Names):
        return lambda x: F.array_compact(F.array(*[F.try_variant_get(x, variant_path([n]), "variant") for n in step.names]))
    if isinstance(step, Every):
        return _members
    if isinstance(step, Deep):
        if step.name is None:
            return lambda x: _deep_column(x, lambda n: F.lit(True), _level_order)
        return lambda x: _deep_column(x, lambda n: F.coalesce(n["name"] == F.lit(step.name), F.lit(False)), lambda n: n["at"])
    if isinstance(step, Places):
        return lambda x: F.array_compact(F.array(*[F.try_variant_get(x, f"$[{i}]", "variant") for i in step.at if i >= 0])) if any(i >= 0 for i in step.at) else F.array().cast(NONE)
    if isinstance(step, Slice):
        return lambda x: _sliced(_items(x), step)
    made = _test_column(step.test, root)
    if step.deep:
        return lambda x: _deep_column(x, lambda n: made(n["v"]), _level_order)
    return lambda x: F.filter(_members(x), made)


def _sliced(items: Column, s: Slice) -> Column:
    """The items and their bounds are made once an array, not once for each of its elements."""
    step = 1 if s.step is None else s.step
    if step < 0:
        return F.slice(items, F.lit(1), F.lit(0))

    def use(found: Column) -> Column:
        size = F.size(found)
        a = F.lit(0) if s.start is None else F.lit(s.start) if s.start >= 0 else size + s.start
        b = size if s.end is None else F.lit(s.end)

        def within(to: Column) -> Column:
            first = F.least(F.greatest(to["lo"], F.lit(0)), size).cast("int")
            some = F.slice(found, first + 1, F.greatest(F.least(to["hi"], size).cast("int") - first, F.lit(0)))
            return some if step == 1 else F.filter(some, lambda _, i: (i + first - to["lo"]) % step == 0)

        return _bound(F.struct(F.least(a, b).cast("bigint").alias("lo"), F.greatest(a, b).cast("bigint").alias("hi")), within)

    return _bound(items, use)


def _test_column(t: Test, root: Column):
    if t.sign in ("&&", "||"):
        a, b = _test_column(t.left, root), _test_column(t.right, root)
        return (lambda x: a(x) & b(x)) if t.sign == "&&" else (lambda x: a(x) | b(x))
    if t.sign == "exists":
        return lambda x: _some(t.left, x, root, lambda v: v.isNotNull())
    if t.sign == "=~":
        return lambda x: _some(t.left, x, root, lambda v: text_of(v).rlike(t.right))
    if isinstance(t.right, Literal):
        return lambda x: _some(t.left, x, root, lambda v: _against(v, t.sign, t.right.value))
    if isinstance(t.left, Literal):
        return lambda x: _some(t.right, x, root, lambda v: _compared(_constant(t.left.value), t.sign, v))
    if _single(t.left) and _single(t.right):
        return lambda x: sure(_compared(column(t.left, x, root), t.sign, column(t.right, x, root)))

    def of_lists(x: Column) -> Column:
        pair = F.struct(*[columns(side, x, root).alias(n) for n, side in (("a", t.left), ("b", t.right))])
        met = lambda s: F.exists(s["a"], lambda a: F.exists(s["b"], lambda b: sure(_compared(a, t.sign, b))))
        return sure(F.get(F.transform(F.array(pair), lambda s: ((F.size(s["a"]) == 1) | (F.size(s["b"]) == 1)) & met(s)), F.lit(0)))

    return of_lists


def _single(path: Path) -> bool:
    return column(path, F.lit(None)) is not None


def _some(side, x: Column, root: Column, holds_for) -> Column:
    """Whether a node of a side holds."""
    if isinstance(side, Literal):
        return sure(holds_for(_constant(side.value)))
    if _single(side):
        return sure(holds_for(column(side, x, root)))
    return F.exists(columns(side, x, root), lambda v: sure(holds_for(v)))


def _constant(value) -> Column:
    if value is MISSING:
        return F.lit(None).cast("variant")
    if value is None or isinstance(value, bool):
        return F.parse_json(F.lit({True: "true", False: "false", None: "null"}[value]))
    return F.lit(value).cast("variant")


SIGNS = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


def _bound(x: Column, use) -> Column:
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _against(a: Column, sign: str, value) -> Column:
    """A node against a constant, by the node's type; its kind is looked at once."""
    if isinstance(value, str):
        whole, double = (long_text(value), double_text_of(value))
        text = SIGNS[sign](F.try_variant_get(a, "$", "string"), F.lit(value))
    elif is_number(value):
        whole, double, text = int(value), float(value), None
    else:
        return F.lit(False)
    kind = kind_of(a)

    def use(k: Column) -> Column:
        out = F.when(k == "STRING", F.lit(False) if text is None else text)
        if whole is not None:
            out = out.when(k.rlike(WHOLE), SIGNS[sign](F.try_variant_get(a, "$", "bigint"), F.lit(whole).cast("bigint")))
        if double is not None:
            out = out.when(k.rlike(FRACTION), SIGNS[sign](F.try_variant_get(a, "$", "double"), F.lit(double)))
        return out

    return _bound(kind, use)


def long_text(s: str) -> int | None:
    try:
        return to_long(s)
    except ValueError:
        return None


def double_text_of(s: str) -> float | None:
    try:
        return to_double(s)
    except ValueError:
        return None


def _compared(a: Column, sign: str, b: Column) -> Column:
    op = SIGNS[sign]

    def use(s: Column) -> Column:
        a, b, ka, kb = (s[n] for n in ("a", "b", "ka", "kb"))
        text = F.try_variant_get(b, "$", "string")
        as_long = F.when(kb == "STRING", long_of(text)).when(kb.rlike(WHOLE), F.try_variant_get(b, "$", "bigint")).when(kb.rlike(FRACTION), F.try_variant_get(b, "$", "double").try_cast("bigint"))
        as_double = F.when(kb == "STRING", double_of(text)).when(kb.rlike(WHOLE) | kb.rlike(FRACTION), F.try_variant_get(b, "$", "double"))
        return (
            F.when((ka == "STRING") & (kb == "STRING"), op(F.try_variant_get(a, "$", "string"), text))
            .when(ka.rlike(WHOLE), op(F.try_variant_get(a, "$", "bigint"), as_long))
            .when(ka.rlike(FRACTION), op(F.try_variant_get(a, "$", "double"), as_double))
        )

    return _bound(F.struct(a.alias("a"), b.alias("b"), kind_of(a).alias("ka"), kind_of(b).alias("kb")), use)


__all__ = ["Path", "Function", "parse_path", "parse_with_functions", "find", "column", "columns", "source", "source_with_functions", "RuleError"]

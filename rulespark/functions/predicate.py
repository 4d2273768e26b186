"""The value-predicate language: names with arguments, && over ||, parentheses.

Every predicate has two forms that agree: a Column over a VARIANT, and a Python test on a JSON value. A value of another type than the
predicate is for makes it false. Names and argument types are checked at compile time, all errors together.
"""

from __future__ import annotations

import re

import regex
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import javaregex
from .cursor import Cursor, RuleError
from .jsonvalue import INTEGER, NUMBER, is_number, to_double

MOST_ARGS = 12
# Date parts.
DATE_PARTS = {"yyyy": r"[12]\d{3}", "mm": r"[01]\d", "dd": r"[0-3]\d"}


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Both:
    sign: str  # && or ||
    left: object
    right: object


def parse(text: str):
    c = Cursor(text)
    c.blanks()
    out = _either(c)
    c.need(c.done())
    return out


def _either(c: Cursor):
    out = _every(c)
    while c.word("||"):
        out = Both("||", out, _every(c))
    return out


def _every(c: Cursor):
    out = _one(c)
    while c.word("&&"):
        out = Both("&&", out, _one(c))
    return out


def _one(c: Cursor):
    if c.take("("):
        c.blanks()
        out = _either(c)
        c.blanks()
        c.need(c.take(")"))
        return out
    name = c.match(r"[A-Za-z_$][A-Za-z0-9_$]*")
    c.need(name)
    args: list[str] = []
    if c.word("("):
        while not c.word(")"):
            c.need(not args or c.word(","))
            m = c.match(r"'((?:\\'|[^'])*)'") or c.match(r"([^\s',()]+)")
            c.need(m)
            args.append(m[1].replace("\\'", "'") if m[0].startswith("'") else m[1])
        c.need(len(args) <= MOST_ARGS)
    return Call(name[0], tuple(args))


# -- Columns over a VARIANT v


def kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_text(v: Column) -> Column:
    return kind_of(v) == "STRING"


#: Names of a VARIANT's number types.
WHOLE, FRACTION = r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$", r"^(DOUBLE|FLOAT|DECIMAL\(\d+,[1-9]\d*\))$"


def is_whole(v: Column) -> Column:
    return kind_of(v).rlike(WHOLE)


def is_fraction(v: Column) -> Column:
    return kind_of(v).rlike(FRACTION)


def text_of(v: Column) -> Column:
    return F.when(is_text(v), F.try_variant_get(v, "$", "string"))


def units(s: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def long_of(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("bigint"))


def double_of(s: Column) -> Column:
    return F.when(s.rlike(r"^\s*[+-]?(NaN|Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?))\s*\z"), s.try_cast("double"))


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Predicate:
    """kind: of the arguments; count: how many, None for any number."""

    kind: str
    count: int | None
    column: Callable
    test: Callable


def _number(compare: Callable, cut: bool) -> tuple[Callable, Callable]:
    """cut: against whole numbers, bounds lose their fraction unless documented semantics are asked for."""

    def column(v, args, documented):
        whole = [int(a) if cut and not documented else a for a in args]
        number = F.try_variant_get(v, "$", "decimal(38,0)")
        by_fraction = compare(F.try_variant_get(v, "$", "double"), *[F.lit(float(a)) for a in args])
        by_whole = F.when(is_whole(v), compare(number, *map(F.lit, whole))).when(is_fraction(v), by_fraction)
        # A decimal that 64 bits would hold was written with a fraction (0.0), so its bounds keep theirs.
        return F.when(kind_of(v).rlike(r"^DECIMAL\(\d+,0\)$") & F.try_variant_get(v, "$", "bigint").isNotNull(), by_fraction).otherwise(by_whole) if cut and not documented else by_whole

    def test(v, args, documented):
        if not is_number(v):
            return False
        return compare(v, *(int(a) if isinstance(v, int) and cut and not documented else a for a in args))

    return column, test


def _text(column: Callable, test: Callable) -> tuple[Callable, Callable]:
    return lambda v, args, _: column(text_of(v), args), lambda v, args, _: isinstance(v, str) and test(v, args)


def _parsed(compare: Callable, whole: bool) -> tuple[Callable, Callable]:
    def test(s, args):
        if not (INTEGER if whole else NUMBER).match(s):
            return False
        return compare(int(s) if whole else to_double(s), *args)

    return _text(lambda s, args: compare(long_of(s) if whole else double_of(s), *map(F.lit, args)), test)


def _class(args) -> str:
    return "".join("\\" + ch if ch in r"\]^-[&" else ch for ch in "".join(args))


def date_pattern(form: str) -> str:
    return re.sub(r"\$\{([^}]*)\}", lambda m: DATE_PARTS.get(m[1], ""), form)


def _any_find(patterns: Callable) -> tuple[Callable, Callable]:
    def column(s, args):
        found = F.lit(False)
        for p in patterns(args):
            found = found | s.rlike(p)
        return found

    return _text(column, lambda s, args: any(javaregex.compiled(p).search(s) for p in patterns(args)))


def _utf16(s: str) -> int:
    return len(s.encode("utf-16-be", "surrogatepass")) // 2


_gt, _lt, _gte, _lte = (lambda x, a: x > a), (lambda x, a: x < a), (lambda x, a: x >= a), (lambda x, a: x <= a)
_between = lambda x, a, b: (x >= a) & (x <= b)
ORDER = {"gt": (1, _gt), "lt": (1, _lt), "gte": (1, _gte), "lte": (1, _lte), "between": (2, _between)}

PREDICATES: dict[str, Predicate] = {
    "_any": Predicate("string", None, lambda v, a, _: F.lit(True), lambda v, a, _: True),
    "_notNull": Predicate("string", None, lambda v, a, _: ~F.is_variant_null(v), lambda v, a, _: v is not None),
    "_isString": Predicate("string", None, *_text(lambda s, a: s.isNotNull(), lambda s, a: True)),
    "_notEmptyString": Predicate("string", None, *_text(lambda s, a: s != "", lambda s, a: s != "")),
    "_oneOf": Predicate("string", None, *_text(lambda s, a: s.isin(*a), lambda s, a: s in a)),
    "_notOneOf": Predicate("string", None, *_text(lambda s, a: ~s.isin(*a), lambda s, a: s not in a)),
    "_digit": Predicate("string", None, *_text(lambda s, a: s.rlike(r"^\p{Nd}*\z"), lambda s, a: all(c.isdecimal() for c in s))),
    "_digitOr": Predicate("string", None, *_text(lambda s, a: s.rlike(rf"^[\p{{Nd}}{_class(a)}]*\z"), lambda s, a: all(c.isdecimal() or c in "".join(a) for c in s))),
    "_charsIn": Predicate("string", None, *_text(lambda s, a: s.rlike(rf"^[{_class(a)}]*\z") if "".join(a) else s == "", lambda s, a: all(c in "".join(a) for c in s))),
    "_charsNotIn": Predicate("string", None, *_text(lambda s, a: ~s.rlike(rf"[{_class(a)}]") if "".join(a) else s.isNotNull(), lambda s, a: not any(c in "".join(a) for c in s))),
    "_regex": Predicate("string", None, *_any_find(lambda a: a)),
    "_date": Predicate("string", None, *_any_find(lambda a: [date_pattern(f) for f in a])),
    "_length": Predicate("long", None, *_text(lambda s, a: units(s).isin(*a), lambda s, a: _utf16(s) in a)),
    "_longerThan": Predicate("long", 1, *_text(lambda s, a: units(s) > a[0], lambda s, a: _utf16(s) > a[0])),
    "_shorterThan": Predicate("long", 1, *_text(lambda s, a: units(s) < a[0], lambda s, a: _utf16(s) < a[0])),
}
for _name, (_n, _op) in ORDER.items():
    PREDICATES |= {
        _name: Predicate("long", _n, *_number(_op, cut=False)),
        _name + "0": Predicate("double", _n, *_number(_op, cut=True)),
        "_" + _name: Predicate("long", _n, *_parsed(_op, whole=True)),
        "_" + _name + "0": Predicate("double", _n, *_parsed(_op, whole=False)),
    }


def register(name: str, predicate: Predicate) -> None:
    """Adds a predicate for rules compiled from now on."""
    PREDICATES[name] = predicate


class ValueRule:
    """A compiled value rule."""

    def __init__(self, text: str, documented: bool = False):
        self.text, self.documented = text, documented
        self.tree = parse(text)
        if wrong := self._wrong(self.tree):
            raise RuleError({"type": "Value Syntax error", "value": text, "result": wrong}, "value")

    def _wrong(self, t) -> list[str]:
        if isinstance(t, Both):
            return self._wrong(t.left) + self._wrong(t.right)
        shown = f"{t.name}({','.join(t.args)})" if t.args else t.name
        p = PREDICATES.get(t.name)
        if p is None:
            return [f"unknown-function:: {shown}"]
        if p.count is not None and len(t.args) != p.count:
            return [f"arg-count must {p.count} :: {shown}"]
        try:
            self._args(t, p)
        except ValueError as e:
            return [f"type error({e}):: {shown}"]
        if t.name == "_regex":
            for a in t.args:
                try:
                    javaregex.compiled(a)
                except regex.error as e:
                    return [f"bad regex({e}):: {shown}"]
        return []

    @staticmethod
    def _args(t: Call, p: Predicate) -> list:
        out: list = []
        for a in t.args:
            if p.kind == "long" and not INTEGER.match(a):
                raise ValueError(f"{a} is not long")
            if p.kind == "double" and not NUMBER.match(a):
                raise ValueError(f"{a} is not double")
            out.append(int(a) if p.kind == "long" else to_double(a) if p.kind == "double" else a)
        return out

    def column(self, v: Column, t=None) -> Column:
        t = self.tree if t is None else t
        if isinstance(t, Both):
            a, b = self.column(v, t.left), self.column(v, t.right)
            return a & b if t.sign == "&&" else a | b
        p = PREDICATES[t.name]
        return sure(p.column(v, self._args(t, p), self.documented))

    def test(self, v, t=None) -> bool:
        t = self.tree if t is None else t
        if isinstance(t, Both):
            a, b = self.test(v, t.left), self.test(v, t.right)
            return a and b if t.sign == "&&" else a or b
        p = PREDICATES[t.name]
        return bool(p.test(v, self._args(t, p), self.documented))

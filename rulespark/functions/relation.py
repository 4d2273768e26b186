"""The relation language between fields: ${path:default}, whole numbers, + - * /, comparisons, && and ||.

Values are 64-bit integers (or doubles, as_float=True). A field that is missing or no number, without a default, and a division by zero
are errors, which win over true and false. Columns report overflow as an error; the Python form wraps.

A rule may hold several expressions: all must hold, every failing one is reported, and each field of any of them is looked up once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cursor import Cursor, RuleError
from .jsonvalue import MISSING, Obj, double_text, to_double, to_long, wrapped
from .outcome import bound
from .predicate import FRACTION, WHOLE, double_of, long_of


@dataclass(frozen=True)
class Number:
    value: int

    def __str__(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Field:
    path: str
    default: int | None

    def __str__(self) -> str:
        return f"${{{self.path}:{'_' if self.default is None else self.default}}}"


@dataclass(frozen=True)
class Op:
    sign: str
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.sign} {self.right})"


class EvaluationError(Exception):
    pass


def parse(text: str):
    c = Cursor(text)
    c.blanks()
    out = _either(c)
    c.need(c.done())
    return out


def _chain(c: Cursor, signs: tuple[str, ...], inner):
    out = inner(c)
    while sign := next((s for s in signs if c.word(s)), None):
        out = Op(sign, out, inner(c))
    return out


def _either(c: Cursor):
    return _chain(c, ("||",), lambda c: _chain(c, ("&&",), _truth))


def _truth(c: Cursor):
    was = c.at
    if c.take("("):  # of truths, or else of numbers
        try:
            c.blanks()
            out = _either(c)
            c.blanks()
            c.need(c.take(")"))
            return out
        except RuleError:
            c.at = was
    left = _sum(c)
    sign = next((s for s in ("<=", ">=", "==", "!=", "<", ">") if c.word(s)), None)
    c.need(sign)
    return Op(sign, left, _sum(c))


def _sum(c: Cursor):
    return _chain(c, ("+", "-"), lambda c: _chain(c, ("*", "/"), _atom))


def _atom(c: Cursor):
    if c.take("("):
        c.blanks()
        out = _sum(c)
        c.blanks()
        c.need(c.take(")"))
        return out
    if m := c.match(r"\$\{([^}]*)\}"):
        whole = m[1].strip()
        d = re.fullmatch(r"(.*):([+-]?\d+)", whole, re.S)
        return Field(d[1], int(d[2])) if d else Field(whole, None)
    m = c.match(r"\d+")
    c.need(m and int(m[0]) < 1 << 31)
    return Number(int(m[0]))


COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def variant_path(route: list[str]) -> str:
    return "$" + "".join(f"['{k}']" if "'" not in k else f'["{k}"]' for k in route)


class Relation:
    """One expression, or several that must all hold."""

    def __init__(self, text: str | list[str], as_float: bool = False):
        self.texts, self.as_float, self.trees, wrong = [text] if isinstance(text, str) else list(text), as_float, [], []
        for t in self.texts:
            try:
                self.trees.append(parse(t))
            except RuleError as e:
                wrong.append(e.tree)
        self.text = ",".join(self.texts)
        if wrong:
            raise RuleError({"type": "Object Syntax error", "value": text, "result": wrong}, "object")

    def __str__(self) -> str:
        return ",".join(map(str, self.trees))

    # -- Columns

    def column(self, v: Column) -> tuple[Column, Column]:
        """(truth, failed)."""
        at = self.outcome(v)
        return at == 0, at == 2

    def outcome(self, v: Column) -> Column:
        """0: all hold, 1: one doesn't, 2: one can't be evaluated."""

        def told(found: dict[Field, Column]) -> Column:
            truths = [self._truth(t, found) for t in self.trees]
            failed, truth = reduce(lambda a, b: a | b, (x for _, x in truths)), reduce(lambda a, b: a & b, (x for x, _ in truths))
            return F.when(failed, 2).when(truth, 0).otherwise(1)

        return self._over_fields(v, told)

    def report(self, v: Column, error: Callable[[Column], Column], false: Callable[[Column], Column]) -> Column:
        """NULL where all hold, else what error makes of the first reason of each expression that can't be evaluated (texts), or false
        of all expressions with their fields' values."""

        def told(found: dict[Field, Column]) -> Column:
            truth = reduce(lambda a, b: a & b, (self._truth(t, found)[0] for t in self.trees))
            reasons = F.array_compact(F.array(*[F.coalesce(*self._reasons(t, found, v), F.when(self._truth(t, found)[1], F.lit("overflow"))) for t in self.trees]))
            shown = F.array(*[self._interim(t, found, v) for t in self.trees])
            return F.when(F.size(reasons) > 0, error(reasons)).when(~truth, false(shown))

        return self._over_fields(v, told)

    def _over_fields(self, v: Column, use: Callable[[dict[Field, Column]], Column]) -> Column:
        """Each field is looked up and decoded once, however often it is named."""
        fields = list(dict.fromkeys(f for t in self.trees for f in self._fields(t)))
        nodes = F.struct(F.lit(0).alias("none"), *[F.try_variant_get(v, variant_path(f.path.split(".")), "variant").alias(f"f{i}") for i, f in enumerate(fields)])

        def decoded(s: Column) -> Column:
            return F.struct(F.lit(0).alias("none"), *[self._decoded(f, s[f"f{i}"]).alias(f"f{i}") for i, f in enumerate(fields)])

        return bound(bound(nodes, decoded), lambda s: use({f: s[f"f{i}"] for i, f in enumerate(fields)}))

    def _fields(self, t) -> list[Field]:
        return [t] if isinstance(t, Field) else [] if isinstance(t, Number) else self._fields(t.left) + self._fields(t.right)

    def _truth(self, t: Op, v: dict[Field, Column]) -> tuple[Column, Column]:
        if t.sign in ("&&", "||"):
            (a, x), (b, y) = self._truth(t.left, v), self._truth(t.right, v)
            return (a & b if t.sign == "&&" else a | b), x | y
        out = COMPARE[t.sign](self._value(t.left, v), self._value(t.right, v))
        return F.coalesce(out, F.lit(False)), out.isNull()

    def _reasons(self, t, v: dict[Field, Column], doc: Column) -> list[Column]:
        """Why t can't be evaluated, in the order of evaluation; each NULL where it is no reason."""
        if isinstance(t, Number):
            return []
        if isinstance(t, Field):
            if t.default is not None:
                return []
            x = F.try_variant_get(doc, variant_path(t.path.split(".")), "variant")
            said = F.when(x.isNull(), F.lit("not found")).otherwise(F.concat(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("null")), F.lit(f" is not {'double' if self.as_float else 'long'}")))
            return [F.when(v[t].isNull(), F.concat(F.lit(f"{t.path} => "), said))]
        out = self._reasons(t.left, v, doc) + self._reasons(t.right, v, doc)
        return [*out, F.when(self._value(t.right, v) == 0, F.lit(f"divide by zero :: {t.right}"))] if t.sign == "/" else out

    def _interim(self, t, v: dict[Field, Column], doc: Column) -> Column:
        if isinstance(t, Op):
            return F.concat(F.lit("("), self._interim(t.left, v, doc), F.lit(f" {t.sign} "), self._interim(t.right, v, doc), F.lit(")"))
        if isinstance(t, Field):
            bare = v[t] if t.default is None else bound(F.try_variant_get(doc, variant_path(t.path.split(".")), "variant"), lambda x: self._decoded(Field(t.path, None), x))
            return F.coalesce(bare.cast("string"), F.lit(f"_:{'_' if t.default is None else t.default}"))
        return F.lit(str(t))

    def _decoded(self, t: Field, x: Column) -> Column:
        """A field's number from its node, whose kind is looked at once."""
        kind, of = ("double", double_of) if self.as_float else ("bigint", long_of)

        def use(k: Column) -> Column:
            fraction = F.try_variant_get(x, "$", "double")
            got = (
                F.when(k.isNull(), None).when(k.rlike(WHOLE), F.try_variant_get(x, "$", kind)).when(k == "STRING", of(F.try_variant_get(x, "$", "string")))
                .when(k.rlike(FRACTION), fraction if self.as_float else fraction.try_cast("bigint"))
            )
            return got if t.default is None else F.coalesce(got, F.lit(t.default).cast(kind))

        return bound(F.schema_of_variant(x), use)

    def _value(self, t, v: dict[Field, Column]) -> Column:
        if isinstance(t, Number):
            return F.lit(t.value).cast("double" if self.as_float else "bigint")
        if isinstance(t, Field):
            return v[t]
        a, b = self._value(t.left, v), self._value(t.right, v)
        if t.sign == "/":
            return F.try_divide(a, b) if self.as_float else F.when(b != 0, _div(a, b))
        return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[t.sign](a, b)

    # -- Python

    def test(self, doc) -> bool:
        """Whether all hold; an EvaluationError has the reasons of all that can't be evaluated."""
        held, reasons = [], []
        for t in self.trees:
            try:
                held.append(self._check(t, doc))
            except EvaluationError as e:
                reasons.append(str(e))
        if reasons:
            raise EvaluationError(*reasons)
        return all(held)

    def _check(self, t: Op, doc) -> bool:
        if t.sign in ("&&", "||"):
            a, b = self._check(t.left, doc), self._check(t.right, doc)
            return a and b if t.sign == "&&" else a or b
        return COMPARE[t.sign](self._number(t.left, doc), self._number(t.right, doc))

    def _field(self, t: Field, doc):
        at = doc
        for k in t.path.split("."):
            at = at.get(k, MISSING) if isinstance(at, Obj) else MISSING
        try:
            if at is MISSING:
                raise ValueError("not found")
            return to_double(at) if self.as_float else to_long(at)
        except ValueError as e:
            if t.default is None:
                raise EvaluationError(f"{t.path} => {e}") from None
            return float(t.default) if self.as_float else t.default

    def _number(self, t, doc):
        if isinstance(t, Number):
            return float(t.value) if self.as_float else t.value
        if isinstance(t, Field):
            return self._field(t, doc)
        a, b = self._number(t.left, doc), self._number(t.right, doc)
        if t.sign == "/":
            if b == 0:
                raise EvaluationError(f"divide by zero :: {t.right}")
            return a / b if self.as_float else wrapped(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
        out = a + b if t.sign == "+" else a - b if t.sign == "-" else a * b
        return out if self.as_float else wrapped(out)

    def interim(self, doc, t) -> str:
        """An expression with its fields' values."""
        if isinstance(t, Op):
            return f"({self.interim(doc, t.left)} {t.sign} {self.interim(doc, t.right)})"
        if isinstance(t, Field):
            try:
                n = self._field(Field(t.path, None), doc)
                return double_text(n) if self.as_float else str(n)
            except EvaluationError:
                return f"_:{'_' if t.default is None else t.default}"
        return str(t)


def _div(a: Column, b: Column) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, b)

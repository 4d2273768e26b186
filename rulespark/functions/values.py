"""The value functions after `::`. Each takes a JSON value and returns one, or fails with a ValueError; the first failure of a chain wins.

`FUNCTIONS` has, by name, the number and types of arguments (checked at compile time) and the function; `COLUMNS` the same functions as
Columns over a string column, NULL for a failure, for plans that stay in generated code.
"""

from __future__ import annotations

import re

import regex
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import javaregex
from .cursor import RuleError
from .jsonpath import Function
from .jsonvalue import MISSING, double_text, is_number, scalar_text, to_double, to_long, wrapped
from .predicate import double_of, kind_of, long_of, units

BLANKS = "".join(map(chr, range(33)))


def _text(v) -> str:
    if not isinstance(v, str):
        raise ValueError("not String")
    return v


def _separated(v, sep: str) -> str:
    s = _text(v)
    if not re.fullmatch(rf"-?\d{{1,3}}(?:{re.escape(sep)}\d{{3}})*(\.\d+)?", s, re.A):
        raise ValueError(f"{s} is not separated by {sep}")
    return s.replace(sep, "")


def _default(run: Callable, default):
    try:
        return run()
    except ValueError:
        return default


def _substring(v, a: int, b: int) -> str:
    """By UTF-16 units; half a surrogate pair becomes U+FFFD."""
    s = _text(v)
    raw = s.encode("utf-16-be", "surrogatepass")
    n = len(raw) // 2
    x, y = a + n if a < 0 else a, b + n if b <= 0 else b
    if not 0 <= x <= y <= n:
        raise ValueError(f"out of range ({a},{b}) :: {s}")
    return raw[2 * x : 2 * y].decode("utf-16-be", "replace")


def _between(v, before: str, after: str, default: str) -> str:
    s = _text(v)
    a = s.find(before)
    b = s.find(after, a + len(before)) if a >= 0 else -1
    return s[a + len(before) : b] if b >= 0 else default


def _replaced(s: str, pattern: str, by: str) -> str:
    p = javaregex.compiled(pattern)
    return p.sub(javaregex.replacement(by, p), s)


def _abs(v):
    if not is_number(v):
        raise ValueError("not numeric")
    return abs(v) if isinstance(v, float) else wrapped(abs(v)) if abs(v) <= 1 << 63 else abs(v)


def _to_text(v, default=None) -> str:
    if v is None or v is MISSING:
        return "" if default is None else default
    if isinstance(v, list):
        if default is None:
            raise ValueError("not a value")
        return default
    return scalar_text(v)


FUNCTIONS: dict[str, tuple[tuple[type, ...], Callable]] = {
    "trim": ((), lambda v: _text(v).strip(BLANKS)),
    "toLower": ((), lambda v: _text(v).lower()),
    "toUpper": ((), lambda v: _text(v).upper()),
    "toLong": ((), lambda v: to_long(_text(v))),
    "toDouble": ((), lambda v: to_double(_text(v))),
    "toLongOr": ((int,), lambda v, d: _default(lambda: to_long(_text(v)), d)),
    "toDoubleOr": ((int,), lambda v, d: _default(lambda: to_double(_text(v)), float(d))),
    "toLongSep": ((str,), lambda v, c: to_long(_separated(v, c))),
    "toDoubleSep": ((str,), lambda v, c: to_double(_separated(v, c))),
    "toLongSepOr": ((str, int), lambda v, c, d: (lambda s: _default(lambda: to_long(s), d))(_separated(v, c))),
    "toDoubleSepOr": ((str, int), lambda v, c, d: (lambda s: _default(lambda: to_double(s), float(d)))(_separated(v, c))),
    "subString": ((int, int), _substring),
    "replace": ((str, str), lambda v, a, b: _text(v).replace(a, b)),
    "regexReplace": ((str, str), lambda v, p, r: _replaced(_text(v), p, r)),
    "replaceIf": ((str, str, str), lambda v, x, t, f: t if _text(v) == x else f),
    "subStringBetween": ((str, str, str), _between),
    "abs": ((), _abs),
    "toString": ((), _to_text),
    "toStringOr": ((str,), _to_text),
}
# Other names of the functions.
ALIASES = {"_" + n: n for n in FUNCTIONS if n not in ("abs", "toString")} | {n: "regexReplace" for n in ("regex", "_regex", "replaceAllIn", "_replaceAllIn")} | {"asString": "toString"}
DOCUMENTED = {
    "toLongSepOr": lambda v, c, d: _default(lambda: to_long(_separated(v, c)), d),
    "toDoubleSepOr": lambda v, c, d: _default(lambda: to_double(_separated(v, c)), float(d)),
}


def register(name: str, kinds: tuple[type, ...], run: Callable) -> None:
    FUNCTIONS[name] = (kinds, run)


def compile_chain(calls: tuple[Function, ...], documented: bool = False) -> list[tuple[str, Callable, tuple]]:
    out = []
    for c in calls:
        name = ALIASES.get(c.name, c.name)
        if name not in FUNCTIONS:
            raise RuleError(f"unknown function :: {c.name}")
        kinds, run = FUNCTIONS[name]
        if len(kinds) != len(c.args) or not all(type(a) is k for a, k in zip(c.args, kinds)):
            raise RuleError(f"arguments of {c.name} must be ({', '.join(k.__name__ for k in kinds)}) :: {c.args}")
        if name == "regexReplace":
            try:
                javaregex.replacement(c.args[1], javaregex.compiled(c.args[0]))
            except regex.error as e:
                raise RuleError(f"bad regex {c.args[0]}: {e}") from None
        out.append((c.name, DOCUMENTED.get(name, run) if documented else run, c.args))
    return out


def run_chain(chain, value):
    for name, run, args in chain:
        try:
            value = run(value, *args)
        except ValueError as e:
            raise ValueError(f"{name} :: {e}") from None
    return value


def _sep(s: Column, c: str) -> Column:
    return F.when(s.rlike(rf"^-?[0-9]{{1,3}}(?:{re.escape(c)}[0-9]{{3}})*(\.[0-9]+)?\z"), F.replace(s, F.lit(c), F.lit("")))


def _cut(s: Column, a: int, b: int) -> Column:
    """By UTF-16 units, which are characters in nearly all texts; half a surrogate pair becomes U+FFFD."""
    n, chars = units(s), F.length(s)
    x, y = n + a if a < 0 else F.lit(a), n + b if b <= 0 else F.lit(b)
    whole = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    cut = F.slice(whole, x + 1, y - x)
    by_units = F.decode(F.unhex(F.array_join(paired(cut), "")), "UTF-16BE")
    return F.when((x >= 0) & (x <= y) & (y <= n), F.when(n == chars, F.substring(s, x + 1, y - x)).otherwise(by_units))


def paired(units_in_hex: Column) -> Column:
    """UTF-16 units in hexadecimal, with FFFD for surrogates without their other half."""
    high, low = r"^[dD][89abAB]", r"^[dD][c-fC-F]"

    def fixed(x: Column, i: Column) -> Column:
        before, after = F.get(units_in_hex, i - 1), F.get(units_in_hex, i + 1)
        lone = (x.rlike(high) & ~F.coalesce(after.rlike(low), F.lit(False))) | (x.rlike(low) & ~F.coalesce(before.rlike(high), F.lit(False)))
        return F.when(lone, F.lit("FFFD")).otherwise(x)

    return F.transform(units_in_hex, fixed)


def _inner(s: Column, before: str, after: str, default: str) -> Column:
    a = F.locate(before, s)
    rest = F.substring(s, a + len(before), F.length(s))
    b = F.locate(after, rest)
    return F.when(s.isNull(), None).when((a > 0) & (b > 0), F.substring(rest, F.lit(1), b - 1)).otherwise(F.lit(default))


COLUMNS: dict[str, Callable[..., Column]] = {
    "trim": lambda s: F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""),
    "toLower": F.lower,
    "toUpper": F.upper,
    "toLong": long_of,
    "toDouble": double_of,
    "toLongOr": lambda s, d: F.coalesce(long_of(s), F.lit(d).cast("bigint")),
    "toDoubleOr": lambda s, d: F.coalesce(double_of(s), F.lit(float(d))),
    "toLongSep": lambda s, c: long_of(_sep(s, c)),
    "toDoubleSep": lambda s, c: double_of(_sep(s, c)),
    "toLongSepOr": lambda s, c, d: F.when(_sep(s, c).isNotNull(), F.coalesce(long_of(_sep(s, c)), F.lit(d).cast("bigint"))),
    "toDoubleSepOr": lambda s, c, d: F.when(_sep(s, c).isNotNull(), F.coalesce(double_of(_sep(s, c)), F.lit(float(d)))),
    "subString": _cut,
    "replace": lambda s, a, b: F.replace(s, F.lit(a), F.lit(b)),
    "regexReplace": lambda s, p, r: F.regexp_replace(s, p, r),
    "replaceIf": lambda s, x, t, f: F.when(s.isNotNull(), F.when(s == x, F.lit(t)).otherwise(F.lit(f))),
    "subStringBetween": _inner,
    "abs": F.abs,
    "toString": lambda s: F.coalesce(s.cast("string"), F.lit("")),
    "toStringOr": lambda s, d: F.coalesce(s.cast("string"), F.lit(d)),
}

#: What a function takes and gives in a chain of Columns, where it isn't text.
TAKES = {"abs": "number", "toString": "any", "toStringOr": "any"}
GIVES = {"abs": "number"} | {n: "number" for n in FUNCTIONS if n.startswith(("toLong", "toDouble"))}


def double_as_sql(x: Column) -> Column:
    """A double as CAST(... AS VARCHAR) writes it, without an exponent from 1e-4 to 1e16; beyond that as Java does."""
    java = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(java.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(java.contains("E") & F.abs(x).between(1e-4, 9999999999999998.0), plain).otherwise(java)


# -- chains as Columns over a VARIANT, with the reasons of failures


def shown(v: Column) -> Column:
    """A node as the text that messages show."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("null"))


def _why(name: str, args: tuple, s: Column) -> Column:
    """Why a function failed on a text."""
    kind = "long" if "Long" in name else "double"
    if "Sep" in name:
        stripped = F.replace(s, F.lit(args[0]), F.lit("")) if args[0] else s
        return F.when(_sep(s, args[0]).isNull(), F.concat(s, F.lit(f" is not separated by {args[0]}"))).otherwise(F.concat(stripped, F.lit(f" is not {kind}")))
    if name in ("toLong", "toDouble"):
        return F.concat(s, F.lit(f" is not {kind}"))
    return F.concat(F.lit(f"out of range ({args[0]},{args[1]}) :: "), s)


def has_columns(calls: tuple[Function, ...]) -> bool:
    """Whether a chain has a Column form: its functions have, and abs follows a number."""
    kind = "any"
    for c in calls:
        name = ALIASES.get(c.name, c.name)
        if name not in COLUMNS or (name == "abs" and kind == "any"):
            return False
        kind = GIVES.get(name, "text")
    return True


def chain_outcome(calls: tuple[Function, ...], v: Column, before: str, documented: bool = False) -> Column:
    """A struct of value and error, JSON texts, for the chain over the node v; before: what an error's text begins with."""
    from .outcome import bound, outcome, quoted

    if not calls:
        return outcome(F.to_json(v), None)

    def fail(name: str, why: Column) -> Column:
        return outcome(None, quoted(F.concat(F.lit(f"{before}{name} :: "), why)))

    def step(k: int, x: Column, kind: str) -> Column:
        """The rest of the chain from x, which is there and of that kind."""
        if k == len(calls):
            # A number is its own JSON text; what isn't one (NaN) is a text, as in trees.
            return outcome(quoted(x) if kind == "text" else x.cast("string"), None)
        call = calls[k]
        name = ALIASES.get(call.name, call.name)
        takes = TAKES.get(name, "text")
        if takes != "any" and takes != kind:
            other = _defaulted(call, name, k)
            return fail(call.name, F.lit("not String" if takes == "text" else "not numeric")) if other is None else other
        if takes == "any" and kind != "text":
            return step(k + 1, x.cast("string"), "text")
        made = _made(name, call.args, x, documented)
        return bound(made, lambda y: F.when(y.isNull(), fail(call.name, _why(name, call.args, x) if name in FAILS else F.lit(""))).otherwise(step(k + 1, y, GIVES.get(name, "text"))))

    def _defaulted(call: Function, name: str, k: int) -> Column | None:
        """toLongOr and toDoubleOr give their default for what is no text."""
        if name not in ("toLongOr", "toDoubleOr"):
            return None
        return step(k + 1, F.lit(call.args[0]).cast("bigint" if name == "toLongOr" else "double"), "number")

    first = calls[0]
    name = ALIASES.get(first.name, first.name)
    if TAKES.get(name) == "any":
        plain = F.coalesce(F.when(kind_of(v) == "VOID", F.lit(first.args[0] if first.args else "")), F.try_variant_get(v, "$", "string"))
        nested = kind_of(v).rlike("^(OBJECT|ARRAY)")
        other = step(1, F.lit(first.args[0]), "text") if first.args else fail(first.name, F.lit("not a value"))
        return F.when(nested, other).otherwise(bound(plain, lambda s: step(1, s, "text")))
    no_text = _defaulted(first, name, 0)
    return F.when(kind_of(v) == "STRING", bound(F.try_variant_get(v, "$", "string"), lambda s: step(0, s, "text"))).otherwise(fail(first.name, F.lit("not String")) if no_text is None else no_text)


#: Functions that fail on some texts.
FAILS = {"toLong", "toDouble", "toLongSep", "toDoubleSep", "toLongSepOr", "toDoubleSepOr", "subString"}


def _made(name: str, args: tuple, x: Column, documented: bool) -> Column:
    if documented and name in DOCUMENTED:
        kind, of = ("bigint", long_of) if name == "toLongSepOr" else ("double", double_of)
        return F.coalesce(of(_sep(x, args[0])), F.lit(args[1]).cast(kind))
    return COLUMNS[name](x, *args)


__all__ = ["FUNCTIONS", "double_as_sql", "chain_outcome", "has_columns", "shown", "ALIASES", "COLUMNS", "TAKES", "GIVES", "compile_chain", "run_chain", "register", "units", "double_text"]

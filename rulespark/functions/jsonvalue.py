"""JSON trees in Python, for what Columns can't express: ordered objects with repeated keys, and strict conversions."""

from __future__ import annotations

import json
import re
from decimal import Decimal


class Obj(list):
    """An object as (key, value) pairs; the first of repeated keys is the one that is read."""

    def get(self, key: str, default=None):
        return next((v for k, v in self if k == key), default)


MISSING = object()
INTEGER = re.compile(r"[+-]?[0-9]+\Z")
NUMBER = re.compile(r"\s*[+-]?(NaN|Infinity|((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[fFdD]?))\s*\Z", re.A)


#: Levels of nesting that are read; deeper texts count as no valid JSON, so one bad document doesn't stop a job.
DEPTH = 300
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def parse(text: str):
    """The tree of a JSON text. ValueError for what is no JSON: NaN and Infinity too, and nesting beyond DEPTH. Lone surrogates become U+FFFD."""
    try:
        out = json.loads(text, object_pairs_hook=Obj, parse_constant=_refused)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    if text.count("[") + text.count("{") > DEPTH and _depth(out) > DEPTH:
        raise ValueError("nested too deeply")
    return _repaired(out) if _SURROGATE.search(text) else out


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def _depth(v) -> int:
    level, n = [v], 0
    while level:
        n += 1
        level = [x for y in level if isinstance(y, list) for x in ((c for _, c in y) if isinstance(y, Obj) else y)]
    return n


def _repaired(v):
    if isinstance(v, Obj):
        return Obj((_repaired(k), _repaired(x)) for k, x in v)
    if isinstance(v, list):
        return [_repaired(x) for x in v]
    return v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(v, str) else v


def dump(v) -> str:
    if isinstance(v, (Obj, dict)):
        return "{" + ",".join(json.dumps(str(k), ensure_ascii=False) + ":" + dump(x) for k, x in (v.items() if isinstance(v, dict) else v)) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(dump, v)) + "]"
    return double_text(v) if isinstance(v, float) else json.dumps(v, ensure_ascii=False)


def pretty(v, indent: str = "") -> str:
    """Two blanks a level, a member a line."""
    inner = indent + "  "
    if isinstance(v, Obj) and v:
        return "{\n" + ",\n".join(f"{inner}{json.dumps(k, ensure_ascii=False)} : {pretty(x, inner)}" for k, x in v) + f"\n{indent}}}"
    if isinstance(v, list) and v:
        return "[\n" + ",\n".join(inner + pretty(x, inner) for x in v) + f"\n{indent}]"
    return dump(v)


def double_text(x: float) -> str:
    """A double as Java writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else ("" if x > 0 else "-") + "Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        s = format(Decimal(repr(x)), "f")
        return s if "." in s else s + ".0"
    sign, digits, exp = Decimal(repr(x)).as_tuple()
    body = "".join(map(str, digits)).rstrip("0") or "0"
    return ("-" if sign else "") + body[0] + "." + (body[1:] or "0") + "E" + str(exp + len(digits) - 1)


def is_number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def wrapped(n: int) -> int:
    """n in 64 bits."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def to_long(v) -> int:
    """Strict: integer text, or a number cut off towards zero."""
    if isinstance(v, str) and INTEGER.match(v) and -(1 << 63) <= int(v) < 1 << 63:
        return int(v)
    if is_number(v):
        return wrapped(int(v)) if v == v and abs(v) != float("inf") else 0
    raise ValueError(f"{scalar_text(v)} is not long")


def to_double(v) -> float:
    if isinstance(v, str) and NUMBER.match(v):
        return float(v.strip().rstrip("fFdD") if v.strip()[-1] in "fFdD" else v)
    if is_number(v):
        return float(v)
    raise ValueError(f"{scalar_text(v)} is not double")


def scalar_text(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return double_text(v)
    return v if isinstance(v, str) else dump(v) if isinstance(v, list) else str(v)

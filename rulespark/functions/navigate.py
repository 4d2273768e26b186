"""Navigation in JSON nodes: a value with three states, and typed accessors.

A node is a VARIANT Column: NULL if it is absent, a VARIANT null if it is JSON's null, else a value. `as_*` take a value that has the
type, `to_*` convert; both give a Result (value, error), of which one is NULL. The value alone is the optional form. A whole number is what a VARIANT
takes for one: 10.0 counts as whole. All of it stays in Columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .outcome import bound
from .predicate import FRACTION, WHOLE, double_of, kind_of, long_of
from .relation import variant_path

LIST = "array<variant>"
MOST = (1 << 63) - 1
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


class Result:
    """value: NULL where it fails; error: why, NULL where it doesn't. `struct` has both."""

    def __init__(self, struct: Column):
        self.struct, self.value, self.error = struct, struct["value"], struct["error"]


def _result(v: Column, make: Callable[[Column], Column], why: Callable[[Column], Column]) -> Result:
    """What make gives for a node, and why says where that is NULL; the node is evaluated once."""

    def told(x: Column) -> Column:
        return bound(make(x), lambda y: F.struct(y.alias("value"), F.when(y.isNull(), why(x)).alias("error")))

    return Result(bound(v, told))


def _text(v: Column) -> Column:
    return F.coalesce(F.to_json(v), F.lit("nothing"))


def _not(what: str) -> Callable[[Column], Column]:
    return lambda x: F.concat(F.lit(f"not {what} : "), _text(x))


def _list(x: Column) -> Column:
    return F.try_variant_get(x, "$", LIST)


def _map(x: Column) -> Column:
    return F.try_variant_get(x, "$", "map<string,variant>")


@dataclass(frozen=True)
class Node:
    v: Column

    # -- states

    def is_nothing(self) -> Column:
        return self.v.isNull()

    def not_nothing(self) -> Column:
        return self.v.isNotNull()

    def is_null(self) -> Column:
        return F.coalesce(F.is_variant_null(self.v), F.lit(False))

    def not_null(self) -> Column:
        """Anything but JSON's null, what is absent too."""
        return ~self.is_null()

    def to_option(self) -> Column:
        """The node itself: NULL where it is absent."""
        return self.v

    non_empty = to_option

    # -- ways to other nodes

    def field(self, name: str) -> Node:
        """The field of an object; of arrays those of their elements, however deep arrays lie in arrays: nothing, the only one, or an array of them."""
        path = variant_path([name])
        return Node(bound(self.v, lambda x: F.when(_list(x).isNotNull(), _of_elements(x, path)).otherwise(F.try_variant_get(x, path, "variant"))))

    def route(self, *names: str) -> Node:
        """Field by field."""
        out = self
        for name in names:
            out = out.field(name)
        return out

    def get(self, *names: str) -> Result:
        """The node at a route; an error if there is none."""
        return Result(bound(self.v, lambda x: F.struct(Node(x).route(*names).v.alias("value"), F.when(Node(x).route(*names).v.isNull(), F.concat(F.lit(f"not exist: {'.'.join(names)} in "), _text(x))).alias("error"))))

    def as_list(self) -> Column:
        """The elements of an array, or the node alone, as an array of nodes."""
        return bound(self.v, lambda x: F.coalesce(_list(x), F.array(x)))

    # -- as: the type must be there

    def _typed(self, what: str, of_kind: str, kind: str) -> Result:
        return _result(self.v, lambda x: F.when(kind_of(x).rlike(of_kind), x if kind == "variant" else F.try_variant_get(x, "$", kind)), _not(what))

    def as_object(self) -> Result:
        return _result(self.v, lambda x: F.when(_map(x).isNotNull(), x), _not("JObject"))

    def as_object_values(self) -> Result:
        """The fields as an array of (key, value), by key."""
        return _result(self.v, lambda x: F.map_entries(_map(x)), _not("JObject"))

    def as_array(self) -> Result:
        return _result(self.v, lambda x: F.when(_list(x).isNotNull(), x), _not("JArray"))

    def as_array_values(self) -> Result:
        return _result(self.v, _list, _not("JArray"))

    def as_double(self) -> Result:
        """A number with a fraction."""
        return self._typed("Double", FRACTION, "double")

    def as_decimal(self) -> Result:
        """A number with a fraction and no exponent, which a VARIANT has as a decimal; as DECIMAL(38,18)."""
        return self._typed("BigDecimal", r"^DECIMAL\(\d+,[1-9]", "decimal(38,18)")

    def as_big_int(self) -> Result:
        return self._typed("BigInt", WHOLE, "decimal(38,0)")

    def as_long(self) -> Result:
        """A whole number of 64 bits."""
        return self._typed("Long", WHOLE, "bigint")

    def as_numeric(self) -> Result:
        return self._typed("Numeric", f"{WHOLE}|{FRACTION}", "variant")

    def as_boolean(self) -> Result:
        return self._typed("Bool", "^BOOLEAN$", "boolean")

    def as_string(self) -> Result:
        return self._typed("String", "^STRING$", "string")

    # -- to: texts and numbers are converted

    def _converted(self, of_text: Callable[[Column], Column], of_whole: Callable[[Column], Column], of_fraction: Callable[[Column], Column], kind: str) -> Result:
        """of_whole takes the number as DECIMAL(38,0), of_fraction the node."""

        def make(x: Column) -> Column:
            text, whole = F.try_variant_get(x, "$", "string"), F.try_variant_get(x, "$", "decimal(38,0)")
            return bound(kind_of(x), lambda k: F.when(k == "STRING", of_text(text)).when(k.rlike(WHOLE), of_whole(whole)).when(k.rlike(FRACTION), of_fraction(x)))

        def why(x: Column) -> Column:
            failed = F.concat(F.lit("string("), F.try_variant_get(x, "$", "string"), F.lit(f") to {kind} failed"))
            return F.when(kind_of(x) == "STRING", failed).otherwise(F.concat(F.lit("not numeric type : "), _text(x)))

        return _result(self.v, make, why)

    def to_long(self) -> Result:
        """Of a number what 64 bits hold: fractions are cut off and stop at the ends, larger whole numbers keep their lowest bits."""
        return self._converted(long_of, _low_bits, lambda x: _saturated(F.try_variant_get(x, "$", "double")), "Long")

    def to_double(self) -> Result:
        return self._converted(double_of, lambda x: x.cast("double"), lambda x: F.try_variant_get(x, "$", "double"), "Double")

    def to_decimal(self) -> Result:
        """As DECIMAL(38,18)."""
        kind = "decimal(38,18)"
        exact = lambda x: F.coalesce(F.try_variant_get(x, "$", kind), F.try_variant_get(x, "$", "double").try_cast(kind))
        return self._converted(lambda s: F.when(s.rlike(_DECIMAL), s.try_cast(kind)), lambda x: x.try_cast(kind), exact, "BigDecimal")

    def to_big_int(self) -> Result:
        """As DECIMAL(38,0); a fraction is cut off in 64 bits first."""
        kind = "decimal(38,0)"
        return self._converted(lambda s: F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast(kind)), lambda x: x, lambda x: _saturated(F.try_variant_get(x, "$", "double")).cast(kind), "BigInt")

    def matches(self, pattern: str) -> Column:
        """Whether the pattern is found in a text; false for anything else."""
        return F.coalesce(self.as_string().value.rlike(pattern), F.lit(False))


def _of_elements(array: Column, path: str) -> Column:
    def one_level(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda x: F.coalesce(_list(x), F.array(x))))

    nested = lambda nodes: F.exists(nodes, lambda x: _list(x).isNotNull())

    def deeper(nodes: Column) -> Column:
        text = F.to_json(array)
        levels = F.length(text) - F.length(F.translate(text, "[", ""))  # arrays in arrays end after so many levels
        return F.aggregate(F.sequence(F.lit(1), levels), nodes, lambda nodes, _: F.when(nested(nodes), one_level(nodes)).otherwise(nodes))

    # Most arrays have no arrays in them, and need no count of levels.
    flat = bound(_list(array), lambda nodes: F.when(nested(nodes), deeper(nodes)).otherwise(nodes))
    found = F.array_compact(F.transform(flat, lambda x: F.try_variant_get(x, path, "variant")))
    return bound(found, lambda f: F.when(F.size(f) == 1, F.get(f, F.lit(0))).when(F.size(f) > 1, f.cast("variant")))


def _saturated(x: Column) -> Column:
    return F.when(x >= float(MOST), F.lit(MOST)).when(x <= -float(MOST), F.lit(-MOST - 1)).otherwise(x.try_cast("bigint"))


def _low_bits(x: Column) -> Column:
    turn = F.lit(str(1 << 64)).cast("decimal(38,0)")
    half = F.lit(str(1 << 63)).cast("decimal(38,0)")
    return F.coalesce(x.try_cast("bigint"), (F.pmod(x + half, turn) - half).try_cast("bigint"))


def node(variant: Column) -> Node:
    return Node(variant)

"""Values and failures as JSON texts in Columns.

An outcome is a struct (value, error) of which exactly one side is NULL. Objects and arrays of outcomes are outcomes again: any failing part fails the
whole, and the failures come back as a tree under the names of their parts. `bound` evaluates a Column once for all places that use it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsonvalue import dump


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(x), use), F.lit(0))


def quoted(s: Column) -> Column:
    """A text as JSON."""
    return F.to_json(s.cast("variant"))


def literal(x) -> Column:
    """A JSON value of the rule, as JSON."""
    return F.lit(dump(x))


def outcome(value: Column | None, error: Column | None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((none if value is None else value).alias("value"), (none if error is None else error).alias("error"))


def either(value: Column, error: Column) -> Column:
    """The value, or the error where it isn't NULL."""
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def members(parts: list[tuple[str, Column]]) -> Column:
    """The members (name, JSON text) of an object that aren't NULL, without braces."""
    return F.concat_ws(",", *[F.concat(F.lit(dump(k) + ":"), x) for k, x in parts])


def braces(inner: Column) -> Column:
    return F.concat(F.lit("{"), inner, F.lit("}"))


def fields(parts: list[tuple[str, Column]]) -> Column:
    """An object of outcomes by name."""
    if not parts:
        return outcome(F.lit("{}"), None)

    def use(s: Column) -> Column:
        got = [(k, s[f"f{i}"]) for i, (k, _) in enumerate(parts)]
        failed = F.coalesce(*[x["error"] for _, x in got])
        return either(braces(members([(k, x["value"]) for k, x in got])), F.when(failed.isNotNull(), braces(members([(k, x["error"]) for k, x in got]))))

    return bound(F.struct(*[x.alias(f"f{i}") for i, (_, x) in enumerate(parts)]), use)


def brackets(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def elements(nodes: Column, each: Callable[[Column], Column], wrap: Callable[[Column], Column] = lambda e: e) -> Column:
    """An array of the outcomes of each node; wrap: what is made of the errors' array."""

    def use(got: Column) -> Column:
        bad = F.filter(F.transform(got, lambda x: x["error"]), lambda e: e.isNotNull())
        return either(brackets(F.transform(got, lambda x: x["value"])), F.when(F.size(bad) > 0, wrap(brackets(bad))))

    return bound(F.transform(nodes, each), use)


def over_documents(df: DataFrame, json_col: str, make: Callable[[Column], Column], outs: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """df with outs, each made from the one Column that `make` gives for the parsed document. Columns of df may have any names; those named as an
    out are replaced."""
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(df.columns)]
    parsed = df.select(*own, F.try_parse_json(F.col(f"`{json_col}`")).alias("_v"))
    made = parsed.withColumn("_o", make(F.col("_v")))
    kept = [F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns) if c not in outs]
    return made.select(*kept, *[use(F.col("_o")).alias(name) for name, use in outs.items()])


TOLD = {"ok": lambda o: o["value"].isNotNull(), "value": lambda o: o["value"], "error": lambda o: o["error"]}

r"""String and time helpers as Columns.

`${key}` keys are letters, digits and points. Escapes are read by a state machine that an aggregate runs over a text's characters, so
nothing leaves the JVM: `\uXXXX` first (any number of u), then the escapes of a single character; there are no octal ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import paired

# Keys, keys with an index, and single-character escapes.
KEY, INDEXED = r"\$\{([a-zA-Z0-9.]+)\}", r"\$\{([a-zA-Z0-9.]+)\[([a-zA-Z0-9.]+)\]\}"
ESCAPES = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


def lift(s: Column) -> Column:
    """NULL for an empty string."""
    return F.nullif(s, F.lit(""))


def interpolate(template: Column, values: dict[str, str | Column]) -> Column:
    """${key} replaced by its value, other keys by nothing; a value is not looked through again."""
    keyed = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]) if values else F.create_map().cast("map<string,string>")
    return _replaced(template, KEY, lambda found: F.try_element_at(keyed, F.regexp_extract(found, KEY, 1)))


def interpolate_each(prefix: str, suffix: str, values: Column, template: Column) -> Column:
    """The template once for each value: ${prefix[suffix]} is the value, any other key with an index nothing."""
    own = re.escape("${" + prefix + "[" + suffix + "]}")
    return F.transform(values, lambda v: _replaced(template, INDEXED, lambda found: F.when(found.rlike("^" + own + r"\z"), v)))


def _replaced(s: Column, pattern: str, value) -> Column:
    """Each place of the pattern replaced by what value makes of it, nothing for a NULL: the text between the places, and their values, in turn."""
    between = F.split(s, re.sub(r"\((?!\?)", "(?:", pattern), -1)
    found = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    values = F.concat(F.transform(found, lambda f: F.coalesce(value(f), F.lit(""))), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, values, lambda a, b: F.concat(a, b)), "")


def has_key(s: Column) -> Column:
    """Whether there is a ${key}."""
    return s.rlike(KEY)


def unescape_unicode(s: Column) -> Column:
    r"""\uXXXX as characters; two that form a surrogate pair are one character, a lone surrogate is U+FFFD."""
    four = lambda m: F.regexp_extract(m, r"([0-9a-fA-F]{4})$", 1)
    run = r"((?:\\u+[0-9a-fA-F]{4})+)"

    def decoded(found: Column) -> Column:
        units = F.transform(F.regexp_extract_all(found, F.lit(r"(\\u+[0-9a-fA-F]{4})"), F.lit(1)), four)
        return F.decode(F.unhex(F.array_join(paired(units), "")), "UTF-16BE")

    return _replaced(s, run, decoded)


def unescape(s: Column) -> Column:
    r"""Escapes as characters: \uXXXX, then \b \t \n \f \r \" \' \\. NULL for any other escape and for one that the text's end cuts off."""
    chars = F.filter(F.split(unescape_unicode(s), ""), lambda c: c != "")
    plain = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])

    def state(out: Column, name: str) -> Column:
        return F.struct(out.alias("out"), F.lit(name).alias("state"))

    def step(a: Column, c: Column) -> Column:
        read = F.try_element_at(plain, c)
        escaped = F.when(read.isNull(), state(a["out"], "bad")).otherwise(state(F.concat(a["out"], F.array(read)), "text"))
        plainly = F.when(c == "\\", state(a["out"], "escape")).otherwise(state(F.concat(a["out"], F.array(c)), "text"))
        return F.when(a["state"] == "bad", a).when(a["state"] == "escape", escaped).otherwise(plainly)

    whole = F.aggregate(chars, state(F.array().cast("array<string>"), "text"), step, lambda a: F.when(a["state"] == "text", F.array_join(a["out"], "")))
    return F.when(s.contains("\\"), whole).otherwise(s)


def date_time(ts: Column) -> Column:
    """With milliseconds, as in 2024-01-02 03:04:05 006."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss SSS")


def elapsed(start: Column, end: Column) -> Column:
    """Milliseconds between two times."""
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))


def time_log(df: DataFrame, start: str, end: str, out: str = "log") -> DataFrame:
    """df with a line on how long each row took."""
    text = F.concat(F.lit("timeLog :: "), date_time(F.col(start)), F.lit(" "), date_time(F.col(end)), F.lit(" elapsed "), elapsed(F.col(start), F.col(end)).cast("string"))
    return df.withColumn(out, text)

"""Classification of texts by many patterns.

Few keywords: every rule is a Column of `contains` and chained `locate`, evaluated by generated code. Many: the keywords of all rules go
into an automaton that each Python worker builds once from a broadcast; all texts of an Arrow batch walk through it side by side, and
rules of one shape are evaluated together (functions/automaton.py). `occurrences` reports every place, text by text. None of them shuffles.

semantics="reference": start and end marks don't restrict, !(a & b) is "none of them" and !(a | b) "not all of them".
semantics="documented": start and end marks hold, and negated groups negate. In both a rule needs a keyword hit to be evaluated at all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import Rules
from ..functions.pattern import Group, Term, compile_rules, terms

try:
    import ahocorasick
except ImportError:  # the plain search below finds the same
    ahocorasick = None

NATIVE_TERMS = 4
#: Bytes of the texts whose places are held at once.
SLICE = 1 << 20
HITS = "array<struct<rule_id:int,rule:string,occurrences:array<struct<keyword:string,loc:array<int>>>>>"


class Classifier:
    def __init__(self, rules, ignore_invalid: bool = False, semantics: str = "reference"):
        if semantics not in ("reference", "documented"):
            raise ValueError(semantics)
        self.rules = compile_rules(rules, ignore_invalid)
        self.documented = semantics == "documented"

    # -- Columns

    def _term(self, t: Term, text: Column) -> Column:
        kw = t.keyword.lower()
        if t.kind == "always":
            hit = F.lit(True)
        elif self.documented and t.kind == "start":
            hit = text.startswith(kw)
        elif self.documented and t.kind == "end":
            hit = text.endswith(kw)
        elif self.documented and t.kind == "exact":
            hit = text == kw
        else:
            hit = text.contains(kw)
        return hit if t.positive else ~hit

    def _rule(self, rule, text: Column) -> Column:
        if isinstance(rule, Term):
            return self._term(rule, text)
        if rule.kind == "~":
            at, ok = F.lit(1), F.lit(True)
            for t in rule.parts:
                if t.kind == "always":
                    ok = ok & (at <= 1)
                    continue
                # A failed step leaves 0, from where `locate` finds nothing.
                at = F.call_function("locate", F.lit(t.keyword.lower()), text, at)
                ok = ok & (at > 0)
            return ok if rule.positive else ~ok
        parts = [self._rule(p, text) for p in rule.parts]
        every = rule.kind == "&"
        if not rule.positive and not self.documented:
            every = not every
        both = reduce(lambda a, b: a & b, parts) if every else reduce(lambda a, b: a | b, parts)
        return both if rule.positive else ~both

    def matches(self, rule_id: int, text: Column) -> Column:
        """Whether the rule holds; false for a null text."""
        rule, low = self.rules[rule_id], F.lower(text)
        hit = reduce(lambda a, b: a | b, (self._term(Term(t.keyword, "contain" if not self.documented else t.kind), low) if t.kind != "always" else F.lit(True) for t in terms(rule)))
        return F.coalesce(hit & self._rule(rule, low), F.lit(False))

    def ids(self, text: Column) -> Column:
        """The ids of the rules that hold, ascending."""
        return F.array_compact(F.array(*[F.when(self.matches(i, text), F.lit(i)) for i in sorted(self.rules)])) if self.rules else F.array().cast("array<int>")

    def transform(self, df: DataFrame, text: str, out: str = "rule_ids", native: bool | None = None) -> DataFrame:
        """df with the ids of the rules that hold for each text."""
        if native is None:
            native = sum(1 for r in self.rules.values() for _ in terms(r)) <= NATIVE_TERMS
        if native:
            return df.withColumn(out, self.ids(F.col(text)))
        shared = df.sparkSession.sparkContext.broadcast(Rules(self.rules, self.documented))
        at = df.columns.index(text)

        def work(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, shared.value.ids(batch.column(at).to_pylist())], names=[*batch.schema.names, out])

        return df.mapInArrow(work, ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{out}` array<int>"]))

    def rows(self, df: DataFrame, text: str, native: bool | None = None) -> DataFrame:
        """A row (df's columns, rule_id, rule) for each rule that holds."""
        named = F.create_map(*[x for i, r in self.rules.items() for x in (F.lit(i), F.lit(str(r)))])
        return self.transform(df, text, "__ids", native).select(*df.columns, F.explode("__ids").alias("rule_id")).withColumn("rule", named[F.col("rule_id")])

    # -- every occurrence

    def occurrences(self, df: DataFrame, text: str, out: str = "hits") -> DataFrame:
        """df with (rule_id, rule, occurrences) of the rules that hold: all places, 0-based, of each of the rule's keywords."""
        engine = Engine(self.rules, self.documented)
        shared = df.sparkSession.sparkContext.broadcast(engine)
        at = df.columns.index(text)
        schema = ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{out}` {HITS}"])
        kind = pa.list_(pa.struct([("rule_id", pa.int32()), ("rule", pa.string()), ("occurrences", pa.list_(pa.struct([("keyword", pa.string()), ("loc", pa.list_(pa.int32()))])))]))

        def work(batches):
            e = shared.value
            for batch in batches:
                for part in slices(batch, at):
                    found = [[] if t is None else e.search(t) for t in part.column(at).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], names=[*batch.schema.names, out])

        return df.mapInArrow(work, schema)


def exact_lookup(df: DataFrame, text: str, keywords: DataFrame, key: str = "id", keyword: str = "keyword") -> DataFrame:
    """A row (df's columns, key) for each keyword of a table that is the whole text, whatever its case: a dictionary of any size, met by an
    equi-join. Both sides join on a hash of the lower-cased text and then on the text, so the dictionary's keys alone decide how rows move, and texts that are
    longer than any keyword never move. Keywords that repeat give a row each; an empty keyword or text and nulls meet nothing."""
    words = keywords.select(F.col(f"`{key}`").alias("_key"), F.lower(F.col(f"`{keyword}`")).alias("_word")).filter(F.length("_word") > 0)
    words = words.withColumn("_hash", F.xxhash64("_word"))
    longest = words.agg(F.coalesce(F.max(F.length("_word")), F.lit(0))).first()[0]
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(df.columns)]
    low = F.lower(F.col(f"`{text}`"))
    rows = df.select(*own, low.alias("_low"), F.xxhash64(low).alias("_of")).filter(F.length("_low").between(1, longest))
    met = rows.join(words, (F.col("_of") == F.col("_hash")) & (F.col("_low") == F.col("_word")))
    return met.select(*[F.col(f"_own{i}").alias(c) for i, c in enumerate(df.columns)], F.col("_key").alias(f"keyword_{key}"))


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SLICE bytes of the texts in column `at`: places take many times a text's room as Python's numbers."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class Engine:
    """All rules' keywords in one automaton, and their evaluation on its hits."""

    def __init__(self, rules: dict[int, Term | Group], documented: bool):
        self.rules, self.documented, self._automaton = rules, documented, None
        self.users: dict[str, set[int]] = defaultdict(set)
        for i, r in rules.items():
            for t in terms(r):
                self.users[t.keyword.lower()].add(i)
        self.names = {i: str(r) for i, r in rules.items()}

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def _places(self, low: str) -> dict[str, list[int]]:
        words = [w for w in self.users if w]
        found: dict[str, list[int]] = defaultdict(list)
        if ahocorasick is not None:
            if self._automaton is None:
                self._automaton = ahocorasick.Automaton()
                for w in words:
                    self._automaton.add_word(w, w)
                self._automaton.make_automaton()
            if words:
                for end, w in self._automaton.iter(low):
                    found[w].append(end - len(w) + 1)
        else:
            for w in words:
                p = low.find(w)
                while p >= 0:
                    found[w].append(p)
                    p = low.find(w, p + 1)
        if "" in self.users:
            found[""] = [0]
        return found

    def search(self, text: str) -> list[dict]:
        low = text.lower()
        found = self._places(low)
        out = []
        for i in sorted(set().union(*(self.users[w] for w in found))) if found else []:
            rule = self.rules[i]
            if self._holds(rule, found, len(low)):
                # Terms of the same keyword each report their places.
                by: dict[str, list[int]] = {}
                for t in terms(rule):
                    if places := self._of(t, found, len(low)):
                        by[t.keyword] = sorted(by.get(t.keyword, []) + places)
                if by:
                    out.append({"rule_id": i, "rule": self.names[i], "occurrences": [{"keyword": k, "loc": v} for k, v in sorted(by.items())]})
        return out

    def _of(self, t: Term, found: dict[str, list[int]], size: int) -> list[int]:
        places = found.get(t.keyword.lower(), [])
        if self.documented and t.kind in ("start", "exact"):
            places = [p for p in places if p == 0]
        if self.documented and t.kind in ("end", "exact"):
            places = [p for p in places if p + len(t.keyword) == size]
        return places

    def _holds(self, rule, found: dict[str, list[int]], size: int) -> bool:
        if isinstance(rule, Term):
            return bool(self._of(rule, found, size)) == rule.positive
        if rule.kind == "~":
            at = 0
            for t in rule.parts:
                at = next((p for p in (found.get(t.keyword.lower(), [])) if p >= at), None)
                if at is None:
                    return not rule.positive
            return rule.positive
        parts = [self._holds(p, found, size) for p in rule.parts]
        every = rule.kind == "&"
        if not rule.positive and not self.documented:
            every = not every
        return (all(parts) if every else any(parts)) == rule.positive

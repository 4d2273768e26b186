"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams of lower-cased bytes is derived: strings that every match must
have give the AND of their trigrams, alternatives an OR. The documents of a block are indexed by those trigrams (postings:
one bit for each document); queries are answered by intersecting and uniting postings, and only the candidates are verified
with the expression, over the whole text. Rules without a mandatory trigram scan all texts; those that are one run of a
byte class do so in one vectorised pass.

Expressions work on UTF-8 bytes (so "either case" is ASCII); offsets are code points. Defined cases: null and empty texts have no
spans; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import LOWER, blocks, read, spans

_parser = re._parser


@dataclass(frozen=True)
class Rule:
    """Matches of fewer than `least` characters in the group are dropped; a span begins where the group `start` does."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    start: int = 0


# The base rules, in order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public formats of keys and tokens.
MORE = (
    Rule("google_key", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("live_key", r"sk_live_[0-9A-Za-z]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    # From the beginning of a run only, so a long run without "://" is read once.
    Rule("url_password", r"(?<![A-Za-z0-9+.-])[0-9+.-]*([A-Za-z][A-Za-z0-9+.-]*)://[^\s:/@]+:[^\s:/@]+@", start=1),
)
RULES = BASE + MORE


def trigram_query(pattern: str):
    """("and" | "or", parts), a trigram as bytes, or True where nothing is mandatory."""

    def grams(s: bytes):
        return _join("and", [s[i : i + 3] for i in range(len(s) - 2)])

    def closed(exact: set[bytes]):
        return _join("or", [grams(s) for s in sorted(exact)])

    def seq(items):
        """(exact strings or None, query)."""
        exact, query, whole = {b""}, True, True
        for op, arg in items:
            e, q = item(str(op), arg)
            if e is not None and len(exact) * len(e) <= 64:
                exact = {x + y for x in exact for y in e}
                query = _join("and", [query, q])
            else:
                query = _join("and", [query, closed(exact), q, True if e is None else closed(e)])
                exact, whole = {b""}, False
        return (exact, query) if whole else (None, _join("and", [query, closed(exact)]))

    def item(op: str, arg):
        if op == "LITERAL":
            return {bytes([arg]).lower()}, True
        if op == "SUBPATTERN":
            return seq(arg[-1])
        if op == "BRANCH":
            parts = [seq(x) for x in arg[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= 64:
                return set().union(*(e for e, _ in parts)), _join("or", [q for _, q in parts])
            return None, _join("or", [q if e is None else _join("and", [q, closed(e)]) for e, q in parts])
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, sub = arg
            e, q = seq(sub)
            if e is not None and (lo, hi) == (0, 1):
                return e | {b""}, True
            return (e, q) if (lo, hi) == (1, 1) else (None, True if not lo else q if e is None else _join("and", [q, closed(e)]))
        if op == "AT":
            return {b""}, True
        return None, True

    e, q = seq(_parser.parse(pattern.encode()))
    return q if e is None else _join("and", [q, closed(e)])


def _join(how: str, parts: list):
    flat: list = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == how else [p]
    if how == "or" and any(p is True for p in flat):
        return True
    flat = list(dict.fromkeys(p for p in flat if p is not True))
    return True if not flat else flat[0] if len(flat) == 1 else (how, tuple(flat))


def byte_class(pattern: str) -> np.ndarray | None:
    """The class, if the pattern is one run of it."""
    parsed = list(_parser.parse(pattern.encode()))
    if len(parsed) == 1 and str(parsed[0][0]) == "MAX_REPEAT" and parsed[0][1][0] == 1 and parsed[0][1][1] is _parser.MAXREPEAT:
        one = re.compile(pattern.encode())
        return np.array([one.fullmatch(bytes([b])) is not None for b in range(256)])
    return None


def _leaves(q) -> set[bytes]:
    return set() if q is True else {q} if isinstance(q, bytes) else set().union(*(_leaves(p) for p in q[1]))


class Index:
    """Postings of a block's documents for the trigrams that the rules ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(i, r, re.compile(r.pattern.encode()), trigram_query(r.pattern), byte_class(r.pattern)) for i, r in enumerate(rules)]
        self.grams = sorted(set().union(*(_leaves(x[3]) for x in self.rules)))
        self.codes = np.array([g[0] << 16 | g[1] << 8 | g[2] for g in self.grams], np.uint32)
        self.near = np.zeros(1 << 16, bool)
        self.near[self._fold(self.codes)] = True

    @staticmethod
    def _fold(code: np.ndarray) -> np.ndarray:
        return code * np.uint32(0x9E3779B1) >> np.uint32(16)

    def postings(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A row of bits, one for each document, by trigram."""
        out = np.zeros((len(self.grams), len(offs) - 1), bool)
        if len(data) < 3 or not self.grams:
            return out
        low = LOWER[data].astype(np.uint32)
        code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
        at = np.flatnonzero(self.near[self._fold(code)])
        which = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        doc = np.searchsorted(offs, at, "right") - 1
        ok = (self.codes[which] == code[at]) & (at + 3 <= offs[doc + 1])
        out[which[ok], doc[ok]] = True
        return out

    def answer(self, q, postings: np.ndarray) -> np.ndarray:
        if q is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(q, bytes):
            return postings[self.grams.index(q)]
        parts = [self.answer(p, postings) for p in q[1]]
        return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Spans (start, rule, end) of each document, in code points, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
        postings = self.postings(data, offs)
        raw: dict[int, bytes] = {}
        for i, rule, regex, query, run in self.rules:
            if query is True and run is not None:
                s, e, _ = spans(run[data], offs)
                long = e - s >= rule.least
                s, e = s[long], e[long]
                for d, a, b in zip((np.searchsorted(offs, s, "right") - 1).tolist(), s.tolist(), e.tolist(), strict=True):
                    found[d].append((a - int(offs[d]), i, b - int(offs[d])))
                continue
            for d in np.flatnonzero(self.answer(query, postings)).tolist():
                if d not in raw:
                    raw[d] = data[offs[d] : offs[d + 1]].tobytes()
                found[d] += [(m.start(rule.start), i, m.end()) for m in regex.finditer(raw[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for d, x in enumerate(found):
            if x:
                lead = np.concatenate([[0], np.cumsum((data[offs[d] : offs[d + 1]] & 0xC0) != 0x80)])
                found[d] = sorted((int(lead[a]), i, int(lead[b])) for a, i, b in x)
        return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) for each row; spans by start, then by the rules' order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(1)):
                rows = [[{"kind": rules[i].kind, "start": p, "end": q} for p, i, q in x] for x in index.scan(data, offs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    some = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", *[F.size(some(k.kind)).cast("long").alias(f"n_{k.kind}") for k in BASE],
        F.sha2(told(some(*(k.kind for k in BASE))).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )

"""Many patterns on many texts at once: an automaton over bytes whose transitions are one numpy table, and rules evaluated by shape.

Texts of a block lie one after another, cut into lanes of equal length that overlap by the longest keyword; one step moves all lanes by a
byte, so a step costs a table lookup for each lane and nothing in Python per character. Bytes that no keyword has share one column of the table. The
table has at most STATES rows; keywords beyond that go into further automata over the same lanes.

What is found is (keyword, text, place), sorted. Rules that differ in their keywords only have one shape and are evaluated together: a
matrix of rules and texts by boolean operations on rows of keywords, sequences by searching the sorted places.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

from .pattern import Group, Term, terms

STATES, LANE, CELLS = 1 << 18, 2048, 1 << 23
BYTES, TEXTS = 1 << 22, 2048  # of a block
END = 0xFF  # stands after each text; no byte of UTF-8


class Table:
    """The automaton of some keywords: next state by state and class of a byte, and the keywords that end in a state."""

    def __init__(self, keywords: list[tuple[int, bytes]]):
        used = np.unique(np.frombuffer(b"".join(w for _, w in keywords), np.uint8))
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        nodes: dict[tuple[int, int], int] = {}
        parent, label, depth, ends = [0], [0], [0], {}
        for number, word in keywords:
            at = 0
            for c in self.classes[np.frombuffer(word, np.uint8)].tolist():
                to = nodes.get((at, c))
                if to is None:
                    to = nodes[at, c] = len(parent)
                    parent.append(at)
                    label.append(c)
                    depth.append(depth[at] + 1)
                at = to
            ends[at] = number
        parent, label, depth = (np.array(x, np.int64) for x in (parent, label, depth))
        n = len(parent)
        self.next = np.zeros((n, width), np.int32)
        back = np.zeros(n, np.int64)
        self.keyword, self.link = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.keyword[list(ends)] = list(ends.values())
        by_depth = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        for level in by_depth[1:]:
            p, c = parent[level], label[level]
            back[level] = np.where(p == 0, 0, self.next[back[p], c])
            self.next[p, c] = level  # over what the parent's row has from its own way back
            self.next[level] = self.next[back[level]]
            f = back[level]
            self.link[level] = np.where(self.keyword[f] >= 0, f, self.link[f])
        self.hit = (self.keyword >= 0) | (self.link > 0)
        self.width = width
        self.flat = self.next.ravel()

    def walk(self, lanes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keyword, lane, step) of all keywords that end at a step of at least `first`; lanes: bytes, a row a step."""
        at = np.zeros(lanes.shape[1], np.int64)
        states, where, when = [], [], []
        for step, row in enumerate(lanes):
            at = self.flat.take(at * self.width + self.classes.take(row)).astype(np.int64)
            if step >= first:
                got = np.flatnonzero(self.hit.take(at))
                if len(got):
                    states.append(at[got])
                    where.append(got)
                    when.append(np.full(len(got), step))
        if not states:
            return (np.zeros(0, np.int64),) * 3
        s, lane, step = (np.concatenate(x) for x in (states, where, when))
        out = []
        while len(s):
            some = self.keyword[s] >= 0
            out.append((self.keyword[s[some]], lane[some], step[some]))
            more = self.link[s] > 0
            s, lane, step = self.link[s[more]], lane[more], step[more]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shape(rule, kinds: bool, slots: list[tuple[str, str]]):
    """The rule without its keywords, which go to slots as (keyword, kind)."""
    if isinstance(rule, Term):
        slots.append((rule.keyword.lower(), rule.kind if kinds or rule.kind == "always" else "contain"))
        return ("term", rule.positive, slots[-1][1])
    return (rule.kind, rule.positive, tuple(shape(p, kinds, slots) for p in rule.parts))


class Rules:
    """Compiled rules, for `ids`."""

    def __init__(self, rules: dict[int, Term | Group], documented: bool):
        words = sorted({t.keyword.lower() for r in rules.values() for t in terms(r) if t.keyword})
        self.words, self.documented = [w.encode("utf-8", "surrogatepass") for w in words], documented
        number = {w: k for k, w in enumerate(words)} | {"": len(words)}  # the last row: what always holds
        self.groups: dict[tuple, tuple[list[int], list[list[int]]]] = defaultdict(lambda: ([], []))
        for i, r in rules.items():
            slots: list[tuple[str, str]] = []
            ids, rows = self.groups[shape(r, documented, slots)]
            ids.append(i)
            rows.append([number[w] for w, _ in slots])
        self.groups = {s: (np.array(i), np.array(rows)) for s, (i, rows) in self.groups.items()}
        self.tables: list[Table] | None = None
        self.long = np.array([*(len(w) for w in self.words), 0], np.int64)

    def __getstate__(self):
        return {**self.__dict__, "tables": None}

    def _tables(self) -> list[Table]:
        if self.tables is None:
            parts, room = [], 0
            for k, w in enumerate(self.words):
                if not parts or room + len(w) > STATES:
                    parts.append([])
                    room = 0
                parts[-1].append((k, w))
                room += len(w)
            self.tables = [Table(p) for p in parts]
        return self.tables

    def ids(self, texts: list[str | None]) -> pa.ListArray:
        """For each text the ids of the rules that hold, ascending; a null text has none."""
        low = [None if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
        out, start, most = [], 0, min(TEXTS, max(16, 4 * CELLS // (len(self.words) + 1)))
        while start < len(low):
            to, size = start, 0
            while to < len(low) and to - start < most and (to == start or size + len(low[to] or b"") <= BYTES):
                size += len(low[to] or b"") + 1
                to += 1
            out.append(self._block(low[start:to]))
            start = to
        counts = np.concatenate([c for c, _ in out] or [np.zeros(0, np.int64)])
        ids = np.concatenate([i for _, i in out] or [np.zeros(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))

    def _block(self, low: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        sizes = np.array([len(t or b"") for t in low], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(b"".join((t or b"") + bytes([END]) for t in low), np.uint8)
        kw, text, place = self._found(data, starts)
        n = len(low)
        there = np.array([t is not None for t in low])
        found = Found(kw, text, place, n, int(sizes.max(initial=0)) + 1, len(self.words) + 1, self.long, sizes, there)
        pairs = []
        for s, (ids, rows) in self.groups.items():
            for at in range(0, len(ids), max(1, CELLS // n)):
                part = rows[at : at + max(1, CELLS // n)]
                # Of what has no keyword in the block nothing is evaluated.
                some = np.flatnonzero(found.any[part].any(1))
                if not len(some):
                    continue
                part = part[some]
                held, used, slot = self._held(s, part, found, 0)
                r, t = np.nonzero(held & used & there)
                pairs.append((t, ids[at + some[r]]))
        if not pairs:
            return np.zeros(n, np.int64), np.zeros(0, np.int64)
        t, i = (np.concatenate(x) for x in zip(*pairs, strict=True))
        order = np.lexsort((i, t))
        return np.bincount(t, minlength=n), i[order]

    def _found(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keyword, text, place in the text's bytes), sorted."""
        if not self.words:
            return (np.zeros(0, np.int64),) * 3
        over = int(self.long.max()) - 1
        lane = max(LANE, 4 * over)
        lane = min(lane, max(64, len(data)))
        many = -(-len(data) // lane)
        padded = np.full(over + many * lane, END, np.uint8)
        padded[over : over + len(data)] = data
        lanes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, over + lane)[:: lane][:many].T)
        got = []
        for t in self._tables():
            k, of, step = t.walk(lanes, over)
            got.append((k, of * lane + step - over + 1 - self.long[k]))
        kw, at = (np.concatenate(x) for x in zip(*got, strict=True))
        text = np.searchsorted(starts, at, "right") - 1
        order = np.lexsort((at, kw))
        return kw[order], text[order], (at - starts[text])[order]

    def _held(self, s: tuple, rows: np.ndarray, f: Found, slot: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(whether it holds, whether one of its keywords stands as its term asks) for rules (by rows of keywords) and texts, and the next slot."""
        kind, positive, inner = s
        if kind == "term":
            there = f.present(rows[:, slot], inner)
            return (there if positive else ~there), there, slot + 1
        if kind == "~":
            used, to = None, slot
            for _, _, k in inner:
                one = f.present(rows[:, to], k)
                used = one if used is None else used | one
                to += 1
            held = f.in_sequence(rows[:, slot:to])
            return (held if positive else ~held), used, to
        every = (kind == "&") == (positive or self.documented)
        held = used = None
        for part in inner:
            h, u, slot = self._held(part, rows, f, slot)
            held = h if held is None else held & h if every else held | h
            used = u if used is None else used | u
        return (held if positive else ~held), used, slot


class Found:
    """Where keywords stand in a block's texts: sorted (keyword, text, place)."""

    def __init__(self, kw, text, place, n_texts: int, span: int, n_words: int, long, sizes, there):
        self.kw, self.text, self.place, self.n, self.span, self.long, self.sizes = kw, text, place, n_texts, span, long, sizes
        self.matrix: dict[str, np.ndarray] = {}
        self.n_words, self.there = n_words, there
        self.key = (kw * n_texts + text) * span + place
        self.any = np.zeros(n_words, bool)
        self.any[kw] = True
        self.any[-1] = True

    def present(self, words: np.ndarray, kind: str) -> np.ndarray:
        """Rows of words by texts: whether a word stands there as the kind asks."""
        if kind not in self.matrix:
            ok = np.ones(len(self.kw), bool)
            if kind in ("start", "exact"):
                ok &= self.place == 0
            if kind in ("end", "exact"):
                ok &= self.place + self.long[self.kw] == self.sizes[self.text]
            m = np.zeros((self.n_words, self.n), bool)
            m[self.kw[ok], self.text[ok]] = True
            m[-1] = self.there
            self.matrix[kind] = m
        return self.matrix[kind][words]

    def in_sequence(self, words: np.ndarray) -> np.ndarray:
        """Whether the words of a row stand in a text one after another, each from the start of the one before; what always holds stands at 0."""
        plain = [self.present(words[:, k], "contain") for k in range(words.shape[1])]
        out = plain[0].copy()
        for p in plain[1:]:
            out &= p
        r, t = np.nonzero(out)
        at = np.zeros(len(r), np.int64)
        ok = np.ones(len(r), bool)
        for k in range(words.shape[1]):
            w = words[r, k]
            always = w == self.n_words - 1
            i = np.searchsorted(self.key, (w * self.n + t) * self.span + at)
            i = np.minimum(i, max(0, len(self.key) - 1))
            same = (self.kw[i] == w) & (self.text[i] == t) & (self.place[i] >= at) if len(self.key) else np.zeros(len(r), bool)
            ok &= np.where(always, at == 0, same)
            at = np.where(always, at, np.where(ok, self.place[i] if len(self.key) else 0, at))
        out[r[~ok], t[~ok]] = False
        return out

"""Rules on whole batches against the evaluation of one text at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulespark.functions import automaton
from rulespark.operators.classifier import Classifier, Engine

LETTERS = "abcé"


def keyword(rng):
    return "'" + "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) + "'"


def rule(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.3:
        return "*" if rng.random() < 0.05 else rng.choice(["", "", "", "!"]) + rng.choice(["", "", "^"]) + keyword(rng) + rng.choice(["", "", "$"])
    if kind < 0.5:
        return rng.choice(["", "!"]) + "(" + " ~ ".join("*" if rng.random() < 0.2 else keyword(rng) for _ in range(rng.randint(2, 4))) + ")"
    return rng.choice(["", "!"]) + "(" + rng.choice([" & ", " | "]).join(rule(rng, depth + 1) for _ in range(rng.randint(2, 3))) + ")"


@pytest.mark.parametrize("semantics", ["reference", "documented"])
@pytest.mark.parametrize("lane, states, texts, cells", [(2048, 1 << 18, 2048, 1 << 23), (64, 10, 3, 5)])
def test_batches_against_single_texts(semantics, lane, states, texts, cells, monkeypatch):
    """Also in short lanes, automata of few keywords, small blocks and few rules at once."""
    for name, x in (("LANE", lane), ("STATES", states), ("TEXTS", texts), ("CELLS", cells)):
        monkeypatch.setattr(automaton, name, x)
    rng, hits = random.Random(lane), 0
    for _ in range(40):
        c = Classifier({i: rule(rng) for i in range(rng.randint(1, 25))}, ignore_invalid=True, semantics=semantics)
        engine, rules = Engine(c.rules, c.documented), automaton.Rules(c.rules, c.documented)
        sample = [None if rng.random() < 0.1 else "".join(rng.choice(LETTERS + " AÉİ") for _ in range(rng.choice([0, 3, 10, 200]))) for _ in range(40)]
        want = [[] if t is None else [h["rule_id"] for h in engine.search(t)] for t in sample]
        assert rules.ids(sample).to_pylist() == want
        hits += sum(map(len, want))
    assert hits > 500


def test_places_against_find():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 6))) for _ in range(12)} | {"ä"})
    rules = automaton.Rules(Classifier({i: f"'{w}'" for i, w in enumerate(words)}).rules, False)
    texts = ["".join(rng.choice(list("abcä"), n)) for n in (0, 1, 50, 7000)]
    data = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in data])])
    kw, text, place = rules._found(np.frombuffer(b"".join(t + b"\xff" for t in data), np.uint8), starts)
    want = [(k, i, p) for k, w in enumerate(words) for i, t in enumerate(data) for p in range(len(t)) if t.startswith(w.encode(), p)]
    assert list(zip(kw.tolist(), text.tolist(), place.tolist(), strict=True)) == want


def test_many_rules_on_a_table(spark):
    """10,000 rules over a frame with other columns, nulls, an empty text, a very long one and no rows at all."""
    parts = ["ta", "ri", "mo", "ne", "ku", "so", "li"]
    word = lambda i: "".join(parts[i // 7**k % 7] for k in range(5))
    c = Classifier({i: f"'{word(i)}' ~ '{word(i * 3 + 1)}'" if i % 2 else f"'{word(i)}' & !'{word(i + 1)}'" for i in range(10_000)})
    rng = random.Random(1)
    texts = [" ".join(word(rng.randrange(16807)) for _ in range(n)) for n in (3, 40, 400, 60_000)] + [None, ""]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, __ids string")
    got = {r["id"]: (r["rule_ids"], r["__ids"]) for r in c.transform(df, "text").collect()}
    engine = Engine(c.rules, False)
    assert got == {i: ([] if t is None else [h["rule_id"] for h in engine.search(t)], "kept") for i, t in enumerate(texts)}
    assert len(got[3][0]) > 1000 and c.transform(df.filter("false"), "text").collect() == []
    assert c.transform(df, "text").select(F.sum(F.size("rule_ids"))).first()[0] == sum(len(x) for x, _ in got.values())

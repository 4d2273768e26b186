"""Scores against plain scorers, matching statistics against brute force, texts beyond a block, empty tables, and tokens against tiktoken."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import tiktoken
import zstandard
from test_llm import BENCH, LINE, PASSAGE, alnum, brute_components, brute_lines, plain, prose, rows_of, solid

from rulespark.llm import _text, bpe, compression_quality, decontaminate, jaccard_join, license_scan, line_dedup, quality_rules, registry, secret_scan, toxicity


def logistic(z):
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_compression_scores_against_a_plain_scorer(spark):
    rows = [(1, prose(i, 90)) for i in range(60)] + [(0, prose(i, 90).upper().replace(" ", " // ")) for i in range(60)]
    model = compression_quality.fit(rows, {0: 60, 1: 60})
    texts = [prose(900, 60), prose(901, 3000), prose(902, 40).upper(), "", "x", "é" * 5000, None]

    def plain_score(text):
        raw = (text or "").encode()
        if not raw:
            x = [math.nan] * 4
        else:
            pieces = max(1, round(len(raw) / compression_quality.PIECE))
            cuts = [len(raw) * i // pieces for i in range(pieces + 1)]
            sizes = []
            for d in model.dictionaries:
                made = zstandard.ZstdCompressor(level=compression_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes.append([len(made.compress(raw[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)])
            good, bad = sizes
            long = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
            x = [(sum(bad) - sum(good)) / len(raw), min((b - g) / n for g, b, n in zip(good, bad, long, strict=True)), sum(map(min, good, bad)) / len(raw), min(min(g, b) / n for g, b, n in zip(good, bad, long, strict=True))]
        z = [0 if math.isnan(v) else (v - c) / s for v, c, s in zip(x, model.centre, model.scale, strict=True)]
        return logistic(sum(w * v for w, v in zip(model.weights, [*z, *(v * v for v in z)], strict=False)) + model.weights[-1])

    got = {r["doc_id"]: r["score"] for r in compression_quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([plain_score(t) for t in texts], abs=1e-6)


def test_toxicity_scores_against_a_plain_scorer(spark):
    make = lambda i: " ".join((w := prose(i, 40).split())[:20] + (["blockhead"] if i % 2 else []) + w[20:])
    model = toxicity.fit([(i % 2, make(i)) for i in range(200)], {0: 100, 1: 100})
    texts = [make(500), make(501), "Blockhead", "a é ÜB 12", "", "!!", None, prose(3, 700) + " blokhead " + prose(4, 9)]

    def bucket(gram):
        h = gram[0]
        for x in gram[1:]:
            h = (h * 0x01000193 + x) % 2**32
        return (h ^ h >> 15) * 0x9E3779B1 % 2**32 >> 32 - toxicity.BUCKET_BITS

    def word_score(word):
        whole = b" " + word + b" "
        grams = [whole[i : i + n] for n in toxicity.GRAMS for i in range(len(whole) - n + 1)]
        return sum(float(model.per_bucket[bucket(g)]) for g in grams) / max(1, len(grams))

    def plain_score(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        scores = [word_score(w) for w in words]
        k = min(toxicity.WINDOW, len(words))
        x = [max(sum(scores[i : i + k]) / k for i in range(len(words) - k + 1)), math.log1p(len(words))] if words else [0, 0]
        return logistic(x[0] * model.weights[0] + x[1] * model.weights[1] + model.weights[2])

    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx([plain_score(t) for t in texts], abs=1e-5)


def test_license_matches_against_all_runs(spark):
    """Maximal runs by brute force: at each word the longest run that ends there and stands in a template; then labels and score from the chains of exactly these."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES)
    templates = [scanner.ids(license_scan.tokens(t)[1]).tolist() for t in license_scan.TEMPLATES.values()]
    rng, texts = random.Random(4), []
    for _ in range(12):
        words = []
        for _ in range(rng.randint(1, 6)):
            t = rng.choice(list(license_scan.TEMPLATES.values())).split()
            a = rng.randrange(len(t))
            words += t[a : a + rng.randint(1, 30)] + ["other"] * rng.randint(0, 3)
        texts.append(" ".join(words))
    rows = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    found = 0
    for i, text in enumerate(texts):
        ids = scanner.ids(license_scan.tokens(text)[1])
        seq = ids.tolist()
        longest = [max((n for n in range(1, e + 2) if any(t[k : k + n] == seq[e - n + 1 : e + 1] for t in templates for k in range(len(t) - n + 1))), default=0) for e in range(len(seq))]
        want = sorted((t, k, e + 1 - n, n) for e, n in enumerate(longest) if n >= license_scan.MIN_MATCH and (e + 1 == len(seq) or longest[e + 1] <= n) for t, x in enumerate(templates) for k in range(len(x) - n + 1) if x[k : k + n] == seq[e + 1 - n : e + 1])
        assert sorted(scanner.matches(ids)) == want
        chains = scanner.spans(ids)
        covered = {c[0]: c[5] / scanner.lengths[scanner.labels.index(c[0])] for c in sorted(chains, key=lambda c: c[5])}
        assert {s["label"] for s in rows[i]["spans"]} == {k for k, v in covered.items() if v >= license_scan.MIN_COVER}
        assert rows[i]["score"] == pytest.approx(min(1.0, max(covered.values(), default=0)))
        found += len(want)
    assert found > 20


@pytest.fixture(scope="module")
def long(spark):
    """Texts beyond a block, alone and beside short ones, with lines, passages and words in common."""
    rng = random.Random(6)
    big = [" ".join(prose(7000 + 10 * k + i, 60) for i in range(1500)) for k in range(2)]
    rows = [(1, big[0]), (2, "short " + LINE), (3, big[0] + " more"), (4, big[1] + "\n" + LINE + "\n" + PASSAGE + " token = 'abcdef123456' é"), (5, None), (6, PASSAGE + "\n" + LINE), (7, "x" * 700_000), (8, "Released under the MIT License " + big[1][:600_000])]
    rng.shuffle(rows)
    assert sum(len(t or "") > _text.BLOCK for _, t in rows) == 5
    return spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(2)


def test_long_texts_in_blocks(spark, long):
    rows = plain(long)
    words = {d: solid(t) for d, t in rows}
    counts = {r["doc_id"]: r for r in quality_rules.text_counts(long, ["doc_id"]).collect()}
    for d, t in rows:
        w = words[d]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[g] > 1 for k in range(3)}
        assert (counts[d]["n_words"], counts[d]["word_chars"], counts[d]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(cover))
    scanned = {r["doc_id"]: r for r in license_scan.scan(long).collect()}
    for d, t in rows:
        assert scanned[d]["n_words"] == len(alnum(t)) and [x["label"] for x in scanned[d]["base"]] == (["mit"] if d == 8 else [])
    secrets = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secret_scan.scan(long).collect()}
    text = dict(rows)[4]
    assert secrets[4] == [("assign", text.index("token"), text.index("123456") + 6)] and not any(secrets[d] for d in (1, 2, 3, 5, 6, 7))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    hits = {r["doc_id"]: (r["n_words"], r["items"]) for r in decontaminate.contamination(long, bench).collect()}
    assert {d: n for d, (n, _) in hits.items()} == {d: len(alnum(t)) for d, t in rows} and {d for d, (_, i) in hits.items() if "4" in i} == {4, 6}


def test_long_texts_compared(spark, long):
    rows = plain(long)
    assert rows_of(jaccard_join.duplicate_components(long.select("doc_id", "text"))) == brute_components(rows)
    want = sorted(((d, n, k, t) for d, n, k, t in brute_lines(rows)), key=repr)
    got = line_dedup.apply_bitmaps(long, line_dedup.keep_bitmaps(long)).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert rows_of(got) == want


@pytest.mark.parametrize("name", ["op3_license_scan", "op5_compression_quality", "op6_secret_scan", "op10_toxicity"])
def test_queries_on_empty_tables(spark, name, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_token_digests_as_registered(spark, tmp_path):
    """op8's own columns, from its query, against tiktoken."""
    import public_tokenizers as P

    rows = [(1, prose(1, 50)), (1, prose(1, 50)), (2, None), (3, ""), (4, "Ünïcode 😀 \t\n  words' I'll 12345"), (None, "no id"), (5, "a" * 3000), (6, "\x00 x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((d, len(ids := known.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for d, t in rows)
    out = registry.QUERIES["op8_bpe"](spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(tuple(r) for r in out.collect()) == want

"""op11 to op13 against brute force, with nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pytest

from rulespark.llm import divergence, html_extract, registry, spelling

SF = "/root/testdata/sf0.001"

# -- op11

LONG = "This paragraph belongs to the main text, and it has a good number of words in it. It even has a second sentence."
PAGES = {
    "": "", "  \n ": "", "<p></p><div> &nbsp; </div>": "", "<": "", "a < b and c > d.": "a < b and c > d.", "Just a sentence.": "Just a sentence.",
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a> {LONG}</nav><article><h1>Head</h1><p>{LONG}</p><p>So.</p></article><footer>{LONG}</footer>": f"Head\n\n{LONG}\n\nSo.",
    f'<body class="has-sidebar"><header><h1>Site</h1></header><div id="sidebar_right"><p>{LONG}</p></div><div class="postBody"><h2>Title</h2><p>{LONG}</p><div class="ad">{LONG}</div><p>Short.</p></div><div id="comments"><article class="comment"><p>{LONG}</p></article></div>': f"Title\n\n{LONG}\n\nShort.",
    f"<div><a href=1>One</a> | <a href=2>Two</a></div><div><h1>Head line</h1><p>{LONG}<p>Short.<p>{LONG} a &lt; b &amp;amp; c&nbsp;d</div>": f"Head line\n\n{LONG}\n\nShort.\n\n{LONG} a < b &amp; c d",
    "<article><p>One <b>two</b>\n\t three<br>four<script>x('</p>')</script> five</p>six<!-- no > --> seven<form>No <input> more</form><p title='a>b'>It's <i title=\"it's\">eight": "One two three four five\n\nsix seven\n\nIt's eight",
    "<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table><dl><dt>h<dd>i</dl></article>": "\n\n".join("abcdefghi"),
    "<article><p>Sources:</p><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p><a href=3>Three</a></article>": "Sources:\n\nOne\n\nTwo\n\nThree",
    "<article><p>a <!-- open <p>b": "a", "<article><p>a <script>open <p>b": "a", "<article><p>a <a href='x": "a", "<article><p>a</p></b></p></span>b": "a\n\nb", "<main><p>x &#233;&#x1F600;&copy y &bogus; z": "x é😀© y &bogus; z",
    '<article><section class="cookie-notice"><p>We use them.</p></section><p>Kept.</p><aside>No.</aside><div role="navigation">No.</div><noscript>No.</noscript></article>': "Kept.",
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert html_extract.main_text(html)[0] == PAGES[html]


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(1500):
        n = rng.randint(1, 7)
        costs = [rng.randint(-9, 9) for _ in range(n - rng.randint(0, min(2, n - 1)))]
        smooth = [(u, v, rng.randint(0, 6)) for u in range(n) for v in range(u) if rng.random() < 0.5]

        def total(keep, costs=costs, smooth=smooth):
            return sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, keep, strict=False)) + sum(w for u, v, w in smooth if keep[u] != keep[v])

        got = html_extract.minimum_cut(costs, n, smooth)
        assert got == list(min(itertools.product([False, True], repeat=n), key=lambda keep: (total(keep), -sum(keep))))


def test_page_labels_are_of_least_cost():
    """The labels of a page's blocks, containers free, against all labellings."""
    html = f'<div><a href=1>One</a></div><div><h3>Head</h3><p>{LONG}</p><p>So</p><div class="ad">x</div><span>y</span></div><div>End</div>'
    page = html_extract.Parser(html)
    blocks = page.run()
    n, smooth = html_extract.edges(blocks)
    costs = [html_extract.cost(b, page.any_on) for b in blocks]
    assert len(blocks) == 7 and n < 14

    def total(keep):
        return sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, keep, strict=False)) + sum(w for u, v, w in smooth if keep[u] != keep[v])

    best = min(itertools.product([False, True], repeat=n), key=lambda keep: (total(keep), -sum(keep)))
    assert html_extract.labelled(html)[1] == list(best)[: len(blocks)]


def test_pages_table(spark):
    rows = [(i, f"u{i}", h, "x") for i, h in enumerate([*PAGES, None])] + [(0, "u0", f"<p>{LONG}</p>", "x"), (None, None, f"<p>{LONG}</p>", "x"), (0, "u0", f"<p>{LONG}</p>", "x")]
    long = "<article>" + "".join(f"<p>word {i}.</p><div class=ad>no</div>" for i in range(20_000))
    rows.append((99, "long", long, "x"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = sorted((tuple(r)[:4] for r in html_extract.extract(df).collect()), key=repr)
    assert got == sorted(((p, u, t := html_extract.main_text(h)[0], len(t)) for p, u, h, _ in rows), key=repr)
    assert next(t for p, _, t, _ in got if p == 99) == "\n\n".join(f"word {i}." for i in range(20_000))
    assert html_extract.extract(df.filter("false")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_against_their_articles(spark):
    """The pages' own articles, cut at block tags, whole table."""
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = registry.QUERIES["op11_mincut_text"](spark, SF)
    assert out.columns[:4] == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert set(got) == set(rows)
    for i, html in rows.items():
        parts = re.split(r"</?(?:p|h\d|li|ul|ol|div|blockquote)\b[^>]*>", re.search(r"<article>(.*?)</article>", html, re.S)[1])
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", p))).split()) for p in parts]
        text = "\n\n".join(p for p in want if p)
        assert got[i] == (text, len(text))


# -- op12


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def spelled(seed: int):
    rng = random.Random(seed)
    letters = "abé" if seed % 2 else "abcdÿß"
    rows = []
    for i in range(60):
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 6, 7]))) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([None, i, i, 10**12 + i]), " ".join(w.title() if rng.random() < 0.2 else w for w in words)))
    return [*rows, rows[3], rows[3], (7, None), (8, ""), (9, "1 2 ¿?"), (10, "stone " * 60 + "Stonez " * 24 + "stonezé " * 9 + "stonezéq " * 3 + "stona " * 60), *[(20 + i, "é" * 3000 + "x" * (i == 2)) for i in range(6)]]


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants(spark, seed, monkeypatch):
    rows = spelled(seed)
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = brute_variants(rows)
    assert any(f and r != f for _, f, r, *_ in want)  # a chain of forms
    for words, nodes, group in ((1 << 16, 1 << 20, 16 << 20), (7, 100, 3000)):
        monkeypatch.setattr(spelling, "SHARD_WORDS", words)
        monkeypatch.setattr(spelling, "SHARD_NODES", nodes)
        monkeypatch.setattr(spelling, "GROUP_BYTES", group)
        assert sorted(tuple(r) for r in spelling.variants(df).select(COLUMNS).collect()) == want
    assert spelling.variants(df.filter("false")).collect() == []


def test_words_are_mangled_by_their_checksum():
    gone = [(d, w) for d in range(2000) for w in ("variant", "é" * 5) if zlib.crc32(f"{d}:{w}".encode()) % 97 == 0]
    assert len(gone) > 20
    for d, w in gone:
        h = zlib.crc32(f"{d}:{w}".encode())
        assert spelling.mangled(w, zlib.crc32(f"{d}:".encode())) == w[: h % len(w)] + w[h % len(w) + 1 :]


@pytest.mark.parametrize("states", [1, 1 << 18])
def test_automata_meet_tries(states, monkeypatch):
    """Every neighbour once, whatever the pieces of the stack."""
    monkeypatch.setattr(spelling, "STATES", states)
    rng = random.Random(states)
    for trial in range(60):
        letters = "abé" if trial % 2 else "abcdefgh"
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))).encode("latin-1") for _ in range(rng.randint(1, 90))})
        shard = spelling.unpacked(spelling.packed(spelling.trie(words, [rng.randint(1, 4) for _ in words])))
        queries = [*words, b"zz", b"aabba"]
        w, x = spelling.neighbours(queries, shard)
        want = [(i, j) for i, a in enumerate(queries) for j, b in enumerate(words) if a != b and one_edit(a.decode("latin-1"), b.decode("latin-1"))]
        assert sorted(zip(w.tolist(), x.tolist(), strict=True)) == want
        at, near, best = spelling.best_of(queries, shard)
        of = defaultdict(list)
        for i, j in want:
            of[i].append(j)
        assert {int(i): (int(k), int(j)) for i, k, j in zip(at, near, best, strict=True)} == {i: (len(js), min(js, key=lambda j: (-shard["n"][j], j))) for i, js in of.items()}


# -- op13


def brute_audit(rows, least=30, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        rate = lambda n, of: 1 + 1_000_000_000 * (n + 5) // (of + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: rate(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: rate(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            for part, listed in (
                ("pair", [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]),
                ("term", [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]),
            ):
                listed.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(listed) if part == "pair" or k < top]
    return sorted(out)


def audited(seed: int):
    rng = random.Random(seed)
    words = ["the", "Of", "été", "日本", "zoë", *(f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(50))]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["a", "a", "b", "c", "é", "zz", None])
        own = words[:8] + rng.sample(words, 6) if source == "a" else words[: 10 + len(source or "") * 12]
        rows.append((lang, source, rng.choice([" ", "1", "_"]).join(rng.choice(own) for _ in range(rng.choice([0, 3, 40])))))
    return [*rows, rows[0], rows[0], ("en", "empty", None), ("xx", "s", "too few"), ("xx", "t", ""), ("en", "long", "the " * 60_000)]


@pytest.mark.parametrize("block, top, least", [(256, 50, 30), (1, 3, 2), (2, 7, 30)])
def test_source_audit(spark, block, top, least, monkeypatch):
    for name, x in (("BLOCK", block), ("TOP", top), ("LEAST_DOCS", least), ("SALTS", 2)):
        monkeypatch.setattr(divergence, name, x)
    rows = audited(block)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, value int, term string").repartition(3)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == brute_audit(rows, least, top)
    assert divergence.audit(df.filter("false")).collect() == []


def test_bounds_stop_the_search():
    """Buckets whose bound lies strictly below the last kept value aren't read; one with an equal bound is, as it may hold a smaller term."""

    def stream(read):
        for bound, values in ((9, [9, 2]), (5, [5, 5]), (5, [5]), (4, [4])):
            read.append(bound)
            yield bound, np.array(values), [b"z%d" % len(read), b"y%d" % len(read)][: len(values)]

    best, n = divergence.bests(stream(read := []), 3)
    assert best == [(9, b"z1"), (5, b"y2"), (5, b"z2")] and n == 3 and read == [9, 5, 5, 4]
    assert divergence.bests(stream([]), 9)[1] == 4


def test_shared_sums_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [rng.integers(1, 5, 40) for _ in range(2)]
    sides = [(np.concatenate([[0], np.cumsum(n)]), np.concatenate([rng.permutation(6)[:k] for k in n]), *(rng.integers(1, 10**9, n.sum()) for _ in range(2))) for n in sizes]
    whole = divergence.shared_sums(sides, (6, 6))
    monkeypatch.setattr(divergence, "AT_ONCE", 5)
    assert (divergence.shared_sums(sides, (6, 6)) == whole).all()


def test_rates_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, kept = 3 * 10**13 + 1, 7 * 10**14 + 3, 12345
    got = spark.range(1).select(divergence.rate(F.lit(n), F.lit(total), F.lit(kept)), divergence.rate(F.lit(n), F.lit(total), F.lit(0))).first()
    assert tuple(got) == (1 + 10**9 * (n + 5) // (total + 5 * kept), None)


# -- against SQL


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op12_spelling_variants", "op13_source_divergence"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    assert got and got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLES[name]})").fetchall(), key=repr)

"""The training-data operators against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows, clashing names and
empty tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobtide.llm import base, binary, decontamination, fingerprints, html, jaccard, langid, mixing, quality, queries, sharding, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASH = {c: 7 for c in ("size", "row", "r", "key", "shard_", "score", "gone", "col", "block", "k1", "j", "i", "id", "t1", "node", "weight", "small", "up", "rate", "sid", "many", "copies", "_range", "_t", "bad", "label", "bytes")}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    rows = [tuple(r) for r in base.load(spark, sf_dir, "documents").limit(150).collect()]
    odd = [
        (10_000, None, "en", "src0", None), (10_001, "", None, None, 0), (10_002, " \n\t ", "en", None, 4), (10_003, "one", "en", "src0", 3), (10_004, "one", "de", "src1", 3),
        (10_005, "word " * 30_000, "en", "src1", 150_000), (10_006, "x" * 50_000, "en", "src0", 50_000), (None, "a b c d e f g", "en", "src0", 13), (10_003, "one", "en", "src0", 3),
        (10_007, "ñandú <|endoftext|> 日本語  two\nlines ", "es", "src2", 33),
    ]
    return rows + odd


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(docs, corpus, none):
    got = mixing.op1(docs).collect()
    assert len(got) == len(corpus)
    size = collections.Counter()
    for _, t, _, s, _ in corpus:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full, target = 1.5 * sum(size.values()), set(), {}
    while True:  # deal, cap, deal the excess again
        level = left / max(sum(weight[s] for s in order if s not in full), 1e-9)
        over = {s for s in order if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
        left -= sum(2 * size[s] for s in over)
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in order}
    largest, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.op1(docs.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.op1(none).count() == 0


def test_mixed_equal_rows(spark):
    """A third of all rows is one row: its copies are dealt evenly and come near the target."""
    rows = [(7, "one two three four five", "en", "a", 1)] * 500 + [(i, f"text {i} of some words", "en", "ab"[i % 2], 1) for i in range(1000)]
    got = mixing.op1(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 1500
    same = [r["taken"] for r in got if r["doc_id"] == 7]
    assert max(same) - min(same) <= 5
    for s in "ab":
        of = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 5 and all(r["taken"] <= 2 * r["size"] for r in of)


def test_mixed_rows(docs):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    n = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    want = {r["doc_id"]: r["n"] for r in mixing.copies(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    assert n == want


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


HARD = ["", " ", "  a  b \n c", "a<|endoftext|> b<|endoftext|>", "\x1c a\x1fb \x85 c", " x", "x ", "\n\n a\t\tb", "don't 'll 's we've", "a" * 3000, "日本語 é ñ", "😀 😀😀 x", "  nb", "᠎ x ​ y", "١٢٣ 12½ ²³", "f.\nBar, x", "a_b (c) \\ ~"]


def test_token_counts(docs, corpus, vocabulary, library, none):
    count = tokens.Counter(vocabulary)
    assert [count(t) for t in HARD] == [len(e) for e in library.encode_batch_fast(HARD, add_special_tokens=False)]
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.op2(docs).collect())
    want = collections.Counter()
    for i, t, *_ in corpus:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 512)] += 1
    assert got == want and tokens.op2(none).count() == 0


def test_heap_merges_like_the_plain_loop():
    random.seed(5)
    letters = "abcd"
    merges = [["a", "b"], ["ab", "c"], ["c", "d"], ["b", "c"], ["abc", "d"], ["a", "a"], ["aa", "a"], ["d", "d"]]
    merger = tokens.HeapMerger(merges)
    rank = {tuple(m): i for i, m in enumerate(merges)}
    for _ in range(300):
        text = "".join(random.choice(letters) for _ in range(random.randrange(1, 30)))
        s = list(text)
        while best := min(((rank[p], i) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in rank), default=None):
            i = best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        assert merger.count(text) == len(s)


def test_quality_is_learned(spark, none):
    sf = "/root/testdata/sf0.01"
    docs, labels = base.load(spark, sf, "documents"), base.load(spark, sf, "labels")
    got = quality.op3(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert quality.op3(none, labels).count() == 0


def test_quality_edges(docs, corpus, spark, sf_dir):
    labels = base.load(spark, sf_dir, "labels").unionByName(spark.createDataFrame([(10_000, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    got = quality.op3(docs, labels).collect()
    assert len(got) == len(corpus) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"]: r["held_out"] for r in got if r["doc_id"] is not None}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in held}
    empty = labels.limit(0)
    assert {r["score"] for r in quality.op3(docs, empty).collect()} == {0.5}
    assert quality.kept(docs, labels).columns == docs.columns


def test_discriminant_matches_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (400, quality.DIM)) @ rng.normal(0, 1, (quality.DIM, quality.DIM)) + c for c in (0, 2)]
    n = np.array([400.0, 400.0])
    m = quality.Discriminant(n, np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), pool=0.0, ridge=0.0)
    probe = np.concatenate([v[:20] for v in x])
    logs = []
    for v in x:
        cov = np.cov(v.T, bias=True)
        d = probe - v.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -700, 700)))
    assert np.allclose(m.scores(probe), want, atol=1e-4)


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("a <b>b</b>c", "a bc"), ("<ul><li>x<li>y</ul>", "- x\n- y"), ("<ol start=3><li>q<li>r</ol>", "3. q\n4. r"),
        ("<ul><li>x<ul><li>y</ul><li>z</ul>", "- x\n  - y\n- z"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<table><tr><td colspan=2>w</td><td>x</td></tr><tr><td>1<td>2<td>3</table>", "w     x\n1  2  3"), ("a<script>b</script>c<style>d</style>", "ac"),
        ("<div hidden>n</div><p style='display: none'>n</p>y", "y"), ("<pre> k\n  l</pre>", " k\n  l"), ("a<br>b", "a\nb"), ("&lt;x&gt; &amp; &eacute;", "<x> & é"), ("a < b <3 c", "a < b <3 c"),
        ("<details><summary>s</summary>h</details>", "s"), ("<details open><summary>s</summary>h</details>", "s\nh"), ("x<!-- no", "x"), ("x<a href='", "x"), ("<title>t</title><body>b", "b"), ("<div>a</div><div>b</div>", "a\nb"),
    ],
)
def test_html(markup, text):
    assert html.render(markup) == text


def test_html_depth_and_table(spark):
    assert html.render("<div>" * 20_000 + "deep") == "deep" and "x" in html.render("<table><tr><td>" * 200 + "x")
    deep = "<table><tr><td>a<td>" * 12 + "x" + "</table>" * 12
    assert html.render(deep).split() == ["a"] * 12 + ["x"]
    aligned = "<table><tr><td>l<td>" * 11 + "<table><tr><td>one<td>2<tr><td>3<td>four</table>" + "</table>" * 11
    assert "one 2 3 four" in html.render(aligned)  # cells of cells are one line, at any depth
    tall = html.render("<table><tr><td rowspan=2000>s<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 1500)) + "</table>").split("\n")
    assert tall[0] == "s  0" and tall[1400] == "   1400"
    pages = spark.createDataFrame([(1, "u", "<p>x"), (2, None, None), (2, "u", ""), (None, "u", "y")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r["page_id"] or 0, r["text"]) for r in html.op4(pages).collect()) == [(0, "y"), (1, "x"), (2, ""), (2, "")]
    assert html.op4(pages.limit(0)).count() == 0


def edit(text, k, rng):
    y = list(text)
    for _ in range(k):
        p = rng.randrange(len(y))
        y[p : p + rng.choice((0, 1))] = [rng.choice("xyz")] if rng.random() < 0.66 else []
    return "".join(y)


def levenshtein_part(window, text):
    """The least distance of the window to a part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(window, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, sf_dir):
    bench = base.load(spark, sf_dir, "benchmark").limit(12)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    rng = random.Random(3)
    filler = " ".join(rng.choice("lorem ipsum dolor sit amet consectetur elit sed eiusmod tempor".split()) for _ in range(60))
    rows = [(1, filler), (2, None), (3, ""), (4, filler + " " + items[0][1].upper() + " " + filler), (5, filler + edit(items[1][1], len(items[1][1]) // 25, rng)), (5, items[2][1].replace(" ", "\n  ")), (6, items[3][1][: len(items[3][1]) // 8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    index = decontamination.Index(items)
    want = set()
    for i, t in rows:
        for item, _, part, k, _ in index.windows:
            if t and levenshtein_part("".join(map(chr, part)), decontamination.fold(t)) <= k:
                want.add((i, item))
    assert {(4, items[0][0]), (5, items[1][0]), (5, items[2][0])} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, bench).collect()} == want
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, bench).collect()) == [1, 2, 3, 6]
    assert decontamination.matches(docs.limit(0), bench).count() == 0 and decontamination.matches(docs, bench.limit(0)).count() == 0
    bad = spark.createDataFrame([(None, None), (7, ""), (8, "short")], "item_id long, text string")
    assert decontamination.matches(docs, bad).count() == 0


def test_slices_find_the_same(spark, sf_dir, monkeypatch):
    """Many slices and short parts of texts, whose seams cut matches, find what one slice and whole texts do."""
    bench = base.load(spark, sf_dir, "benchmark")
    assert sum(len(x) for x in decontamination.slices(bench, 500)) == bench.count() and len(list(decontamination.slices(bench, 500))) > 1
    items = [r["text"] for r in bench.limit(6).collect()]
    rng = random.Random(8)
    filler = " ".join(rng.choice("lorem ipsum dolor sit amet consectetur elit sed eiusmod tempor".split()) for _ in range(300))
    rows = [(i, filler[: 60 * i] + " " + items[i % 6] + " " + filler + items[(i + 1) % 6]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, decontamination.matches(docs, bench).collect()))
    assert len(whole) >= 60
    monkeypatch.setattr(decontamination, "AT_ONCE", 700)
    monkeypatch.setattr(decontamination, "TOGETHER", 2)
    monkeypatch.setattr(decontamination, "slices", lambda b, real=decontamination.slices: real(b, 5000))
    assert sorted(map(tuple, decontamination.matches(docs, bench).collect())) == whole


def test_pieces_hold_every_match():
    """The scan by the bitmap loses nothing that the search of the whole text finds; excerpts of a long item of each length and place."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    item = " ".join(word() for _ in range(110))[:600]
    short = [" ".join(word() for _ in range(n)) for n in (2, 3, 5, 9)]
    items = [(0, item), *enumerate(short, 1)]
    index = decontamination.Index(items)
    lengths = {e - s for _, x in items for s, e in decontamination.windows(decontamination.letters(decontamination.fold(x)))}
    bitmaps = {q: np.zeros(1 << 19, np.uint8) for q in (8, 10)}
    for _, x in items:
        for q, bitmap in bitmaps.items():
            h = decontamination.short_grams(decontamination.letters(decontamination.fold(x)), q) >> np.uint32(10)
            np.bitwise_or.at(bitmap, h >> np.uint32(3), np.uint8(1) << (h & np.uint32(7)).astype(np.uint8))
    known = decontamination.Known(22, bitmaps, sorted(lengths))
    assert set(known.least) == {8, 10}
    noise = " ".join(word() for _ in range(400))
    texts = []
    for size in (74, 80, 100, 120, 140, 160):
        texts += [noise[:200] + item[s : s + size] + noise[300:700] for s in range(0, len(item) - size, 7)]
    texts += [noise + edit(x, decontamination.slack_of(len(x)), rng) + noise for x in short for _ in range(5)] + [noise, "", None, "é" * 300]
    for text, found in zip(texts, decontamination.pieces(known, texts), strict=True):
        whole = {(index.windows[w][0], s, e) for w, s, e, _ in index.search(decontamination.letters(decontamination.fold(text)))}
        assert whole == {(index.windows[w][0], s + at, e + at) for at, part in found for w, s, e, _ in index.search(decontamination.letters(part))}
    n = len(texts) - 24
    assert all(any(index.windows[w][0] == 0 for w, *_ in index.search(decontamination.letters(decontamination.fold(t)))) for t in texts[:n])  # no blind spot from 74 letters on


def test_language(spark, sf_dir):
    docs = base.load(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    fresh = docs.filter(F.pmod(F.xxhash64(F.lit(99), "doc_id"), F.lit(5)) == 0).filter("n_chars > 200").limit(150).collect()
    right = [model.languages[int(np.argmax(model.likelihood(r["text"])))] == r["lang"] for r in fresh]
    assert np.mean(right) > 0.97
    text = {r["lang"]: r["text"][:300] for r in fresh}
    rows = [(i, f"http://w.de.example/{i}", f"<p>{text['de']}") for i in range(8)] + [(9, "http://w.de.example/9", ""), (10, None, None), (11, "http://o.example/", f"<html lang=fr><p>{text['fr']}"), (12, "x", "<html lang='en'>"), (12, "x", "<html lang='en'>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    got = {r["page_id"]: r for r in langid.identify(pages, model).collect()}
    assert all(got[i]["lang"] == "de" for i in range(8)) and got[9]["lang"] == "de" and got[11]["lang"] == "fr" and got[9]["text_lang"] is None
    assert langid.identify(pages.limit(0), model).count() == 0 and {r["lang"] for r in langid.identify(pages, langid.fit(docs.limit(0))).collect()} == {None}


def test_evidence_is_fused(spark):
    """Languages and confidences against the formula, page by page, with the other pages of its host, domain, suffix and declaration."""
    docs = base.load(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs)
    L, rng = len(model.languages), random.Random(11)
    texts = [r["text"][:120] for r in docs.filter("n_chars > 200").orderBy("doc_id").limit(30).collect()]
    rows = [(i, rng.choice(["http://a.x.de/en/p", "http://b.x.de/", "https://y.fr/fr/1", "http://z.co.uk", None, "no url"]), rng.choice(["<html lang=de>", "<html lang='fr'>", "", "<html>"]) + rng.choice([*texts, ""])) for i in range(60)] + [(60, None, None)]
    got = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    like, post, keys = [], [], []
    for _, url, markup in rows:
        like.append(model.likelihood(html.render(markup)))
        raw = np.exp(like[-1]) * model.share
        post.append(raw / raw.sum())
        host, domain, suffix = langid.address(url)
        keys.append({"host": (host, domain) if host else None, "domain": domain, "suffix": suffix, "mark": langid.declared(markup)})
    every = sum(post)
    for i, (page, *_) in enumerate(rows):
        others = {k: [post[j] for j in range(len(rows)) if j != i and keys[j][k] == keys[i][k] and keys[i][k]] for k in keys[i]}
        n = {k: len({x[k] for x in keys if x[k]}) for k in ("suffix", "mark")}
        score = np.zeros(L)
        for c in range(L):
            of = lambda k, c=c: sum(p[c] for p in others[k])
            prior = (every[c] + 0.5) / (every.sum() + 0.5 * L)
            prior = (of("domain") + 5 * prior) / (len(others["domain"]) + 5)
            prior = (of("host") + 5 * prior) / (len(others["host"]) + 5)
            score[c] = like[i][c] + np.log(prior)
            for k in ("suffix", "mark"):
                if keys[i][k]:
                    score[c] += np.log((of(k) + 0.5) / (every[c] + 0.5 * (n[k] + 1)))
        chance = np.exp(score - score.max())
        assert got[page]["confidence"] == pytest.approx((chance / chance.sum()).max(), rel=1e-6)
        assert got[page]["lang"] == model.languages[int(score.argmax())]


def test_address():
    assert langid.address("https://u@Blog.X.co.uk:80/EN/a?b") == ("blog.x.co.uk", "co.uk", "uk/en") and langid.address(None) == (None, None, None)


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        g = top(i)
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return collections.Counter((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard(spark, n, percent):
    rng = random.Random(n)
    common = [f"c{i}" for i in range(12)]
    rows, d = [], 0
    for _ in range(12):
        parent = [rng.choice(common + [f"w{rng.randrange(400)}"] * 30) for _ in range(rng.randrange(8, 90))]
        for _ in range(rng.randrange(1, 7)):
            child = list(parent)
            for _ in range(rng.randrange(0, 3)):
                child[rng.randrange(len(child))] = f"e{rng.randrange(50)}"
            rows.append((d, " ".join(child + common * rng.randrange(2))))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " \t"), (d + 3, "One TWO"), (d + 4, "one two"), (d + 4, "one two"), (d + 5, "z " * 5000), (None, "one two"), (d + 6, "É é"), (d + 7, "é é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"r": F.lit(1), "col": F.lit(2)})
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, n, percent).collect())
    assert got == brute_components(rows, n, percent)


def test_jaccard_parts(spark, monkeypatch):
    """Blocks that are cut: rows that share columns and link in chains, a family of near copies, hot columns in several parts."""
    monkeypatch.setattr(jaccard, "BLOCK", 600)
    monkeypatch.setattr(jaccard, "ROW", 4)
    rng = random.Random(2)
    rows = [(i, " ".join(f"t{j}" for j in range(3 * i, 3 * i + 30))) for i in range(12)] + [(100 + i, " ".join(f"t{j}" for j in range(i, i + 22))) for i in range(10)]
    for k in (200, 300):  # two families around one text
        parent = [f"p{j}" for j in range(20)] + [f"q{k}{j}" for j in range(5)]
        rows += [(k + i, " ".join(parent + [f"x{rng.randrange(40)}" for _ in range(rng.randrange(3))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, 1, 80).collect())
    assert got == brute_components(rows, 1, 80)


def test_second_round_of_large_components(spark, monkeypatch):
    """A cut family of two large components and single rows: all pairs that may link meet, yet a large component's rows don't meet each other."""
    monkeypatch.setattr(jaccard, "BLOCK", 600)
    monkeypatch.setattr(jaccard, "ROW", 4)
    rng = random.Random(4)
    labels = [b"A"] * 300 + [b"B"] * 60 + [b"%d" % i for i in range(8)]
    rows = [(7, rng.randbytes(16), rng.choice((18, 20, 23, 30)), label) for label in labels]
    families = base.park(spark.createDataFrame([r[:3] for r in rows], "g long, r binary, size int"))
    comps = base.park(spark.createDataFrame([(r[1], r[3]) for r in rows if len(r[3]) == 1 and r[3].isalpha()], "r binary, c binary"))
    got = jaccard._second(families, jaccard._large(families), comps, 80).collect()
    size, blocks = {r[1]: r[2] for r in rows}, collections.defaultdict(list)
    for x in got:
        blocks[x["block"]].append(x)
    met = {frozenset((bytes(a["r"]), bytes(b["r"]))) for x in blocks.values() for a, b in itertools.combinations(x, 2) if a["label"] != b["label"] and a["side"] != b["side"]}
    single = {r[1]: r[3] if r[3].isalpha() else r[1] for r in rows}
    for a, b in itertools.combinations(single, 2):
        if single[a] != single[b] and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b]):
            assert frozenset((a, b)) in met
    assert max(sum(size[bytes(x["r"])] + 4 for x in b) for b in blocks.values()) < 2 * 600
    assert len(got) < 12 * len(rows)


def test_round_between_joins_near_copies(spark, monkeypatch):
    """Near copies in a large family of which the first round links none are linked by their parts, before every two parts meet."""
    monkeypatch.setattr(jaccard, "BLOCK", 3000)
    monkeypatch.setattr(jaccard, "ROW", 4)
    found, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda *a: found.append(base.park(links(*a))) or found[-1])
    rng, parent = random.Random(5), [f"p{j}" for j in range(40)]
    rows = []
    for i in range(240):
        words = [*parent]
        for _ in range(rng.randrange(3, 6)):
            words[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, 1, 80).collect())
    assert got == brute_components(rows, 1, 80)
    assert len(found) == 3
    assert found[2].count() < len(rows)


def test_jaccard_hot_columns(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_salts", lambda counter: np.full(np.shape(counter), 3))
    rows = [(i, " ".join(f"t{j}" for j in range(2 * (i % 20), 2 * (i % 20) + 25)) + f" u{i % 25}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df, 1, 80).collect())
    assert got == brute_components(rows, 1, 80)


@pytest.mark.parametrize("n", range(1, 7))
def test_few_words(n):
    """Groups of texts of 0 to 6 words each, and all together."""
    texts = [" ".join("abcdefg"[:k]) for k in range(7)]
    together = [len(x) for x in jaccard.rows_of(texts, n)]
    assert together == [max(k - n + 1, min(k, 1)) for k in range(7)]
    assert together == [len(jaccard.rows_of([t], n)[0]) for t in texts]


def test_words_are_told_apart():
    """Regular words, of which a polynomial modulo a power of two takes some for equal, and words on both sides of LONG."""
    thue = lambda k, x="a", y="b": x if not k else thue(k - 1, x, y) + thue(k - 1, y, x)
    words_ = [thue(k, *p) for k in range(4, 14) for p in ("ab", "ba")] + ["x" * k for k in range(250, 262)]
    found = [x[0] for x in jaccard.rows_of(words_, 1)]
    assert len(set(found)) == len(words_)
    assert [x[0] for w in words_ for x in jaccard.rows_of([w], 1)] == found
    together = jaccard.rows_of([" ".join(words_ * 40)], 1)[0]  # over AT_ONCE bytes
    assert len(" ".join(words_ * 40)) > jaccard.AT_ONCE and set(together.tolist()) == set(int(x) for x in found)


@pytest.mark.parametrize("m", [2, 7, 60, 300])
def test_product_of_a_block(m):
    """The forest of a block against all pairs, with columns that few and that many rows hold."""
    rng = np.random.default_rng(m)
    base_ = [rng.choice(5000, 60, replace=False) for _ in range(max(2, m // 20))]
    cells = []
    for i in range(m):
        row = base_[i % len(base_)].copy()
        row[: rng.integers(0, 9)] += 10_000 + i
        cells.append(np.unique(np.concatenate((row, np.arange(9000, 9000 + rng.integers(0, 12))))).astype(np.uint64))
    side = rng.integers(0, 3, m)
    for apart in ((), (side,)):
        up = list(range(m))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for i in range(m):
            for j in range(i):
                both = len(np.intersect1d(cells[i], cells[j]))
                if 100 * both >= 80 * (len(cells[i]) + len(cells[j]) - both) and (not apart or side[i] != side[j]):
                    up[top(i)] = top(j)
        edges = jaccard.linked(cells, 80, apart)
        two = list(range(m))
        for i, j in edges:
            assert top(i, two) != top(j, two)  # a forest
            two[top(i, two)] = top(j, two)
        assert len({(top(i), top(i, two)) for i in range(m)}) == len({top(i) for i in range(m)}) == len({top(i, two) for i in range(m)})


def test_product_without_a_common_column():
    cells = [np.arange(k, k + 20, dtype=np.uint64) for k in (0, 100, 200)]
    assert jaccard.linked(cells, 80) == jaccard.linked(cells, 80, (np.arange(3),)) == []


def bridged(n, percent, size):
    """Two texts without a common n-gram, whose profiles are equal and which a third, smaller one brings into one block by a prefix column each; that
    one is too far from both by its profile. In longer texts stand all their other n-grams, so that these aren't in prefixes."""
    rng = random.Random(n)
    shape = lambda text: jaccard.profile(jaccard.rows_of([text], n)[0])
    fresh = lambda k: [f"v{rng.randrange(10**9)}" for _ in range(k)]
    least = fresh(size + n - 1)
    heads = {shape(" ".join(t)): t for t in (least[:n] + fresh(size) for _ in range(3000))}
    tails = {shape(" ".join(t)): t for t in (fresh(size) + least[-n:] for _ in range(3000))}
    own = np.frombuffer(shape(" ".join(least)), np.uint8).astype(int)
    far = lambda x: 100 * (most := np.minimum(own, np.frombuffer(x, np.uint8)).sum()) < percent * (2 * size + 1 - most)
    found = next(x for x in heads if x in tails and far(x))
    head, tail = heads[found], tails[found]
    texts = [least, head, tail] + [t + fresh(60) for t in (least[1:-1], head[1:], tail[:-1]) for _ in range(3)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_op7_bridged(spark):
    rows = bridged(3, 90, 10)
    got = collections.Counter(tuple(r) for r in jaccard.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows, 3, 90)


def test_jaccard_as_in_sql(spark, sf_dir):
    from tests.oracle import compare, connect

    compare(spark, connect(sf_dir), sf_dir, queries.QUERIES["op7_jaccard"], queries.ORACLE["op7_jaccard"])


def test_components_both_ways(spark, monkeypatch):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1020)]
    df = spark.createDataFrame(links, "a long, b long")
    one = {tuple(r) for r in jaccard.components(df).collect()}
    monkeypatch.setattr(jaccard, "EDGES", 0)
    assert {tuple(r) for r in jaccard.components(df).collect()} == one and (1020, 1000) in one


def test_one_each(docs, none):
    kept = jaccard.one_each(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[10_003] == 1 and ids[10_004] == 0 and ids[10_000] == ids[10_001] == 1 and ids[None] == 1
    assert jaccard.one_each(none).count() == 0


def test_one_each_bridged(spark):
    rows = bridged(5, 80, 5)
    assert sorted(tuple(r) for r in jaccard.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == rows


def test_one_each_goes_by_row(spark):
    w = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, w), (5, w), (5, "something else altogether in every way and word here"), (None, w), (None, "lone words of a row without any number at all"), (None, None), (None, None), (8, ""), (8, ""), (9, "tail of it " * 3), (9, "tail of it " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("gone", "row", "c", "d", "_d", "stays", "h1", "n", "first")})
    kept = jaccard.one_each(df)
    assert kept.columns == df.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == collections.Counter([rows[0], rows[2], rows[3], rows[4], rows[5], rows[6], rows[7], rows[8], rows[9]])


def test_fingerprints(spark, docs, corpus, none):
    got = fingerprints.op8(docs).collect()
    assert len(got) == len(corpus)
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = [r[1] or "" for r in rows]
    known = collections.defaultdict(set)
    for k, (r, t) in enumerate(zip(rows, texts, strict=True)):
        cut, after = len(t) // 3, texts[(k + 1) % len(texts)]
        known[r[0]].add((len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    for r in got:
        assert (r["n_chars"], r["edited_sha256"]) in known[r["doc_id"]] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_text = collections.defaultdict(set)
    print_of = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in got}
    for i, t, *_ in corpus:
        by_text[t or ""].add(print_of[(i, len(t or ""))])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.op8(none).count() == 0
    few = spark.createDataFrame([(5, "a b c")], "doc_id long, text string")
    assert fingerprints.op8(few).first()["near_next"] == 1.0


@pytest.mark.parametrize(("rows_a_range", "most"), [(12, 1000), (7, 3), (3, 1)])
def test_fingerprints_by_ranges(spark, corpus, monkeypatch, rows_a_range, most):
    """Many ranges, and few that are cut in pieces: the same as one range. With nulls, repeated ids and an uneven spread of ids."""
    rows = [(r[0], r[1]) for r in corpus if len(r[1] or "") < 2000]
    rows += [(None, f"n{i} of none") for i in range(9)] + [(5, "again"), (5, "again"), (1 << 60, "far " * 9), (-(1 << 60), "low end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = collections.Counter(map(tuple, fingerprints.op8(df).collect()))
    real = fingerprints.Ranges.of.__func__
    monkeypatch.setattr(fingerprints.Ranges, "of", classmethod(lambda cls, x: real(cls, x, rows_a_range, most)))
    assert collections.Counter(map(tuple, fingerprints.op8(df).collect())) == whole


def signature(text):
    """The fingerprint by plain Python over the hashes that Spark gives: xxhash64 with its seed of 42."""
    import xxhash

    def chain_(values):
        h = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else (v & ((1 << 64) - 1)).to_bytes(8, "little") if not isinstance(v, tuple) else v[0].to_bytes(4, "little")
            h = xxhash.xxh64_intdigest(raw, h)
        return h

    low = (1 << 28) - 1
    w = [chain_([x]) for x in re.split(" +", text.translate(str.maketrans("\t\n\x0b\f\r", "     ")).strip(" "))]
    if w == [chain_([""])]:
        return "-" * 512
    grams = [(chain_(w) << 28) & ((1 << 64) - 1)] if len(w) < 5 else [(chain_(w[i : i + 5]) & ~low) | i for i in range(len(w) - 4)]
    seen, occurrences = collections.Counter(), []
    for g in sorted(grams, key=lambda x: x - (1 << 64) if x >> 63 else x):
        kmer, n = g & ~low, seen[g >> 28]
        seen[g >> 28] += 1
        occurrences.append((chain_([kmer >> 28, (n,)]) & ~low) | (g & low))
    r = sorted(occurrences, key=lambda x: x - (1 << 64) if x >> 63 else x)
    parts = ["-" * 8] * 64
    for i, x in enumerate(r):
        if i and r[i - 1] >> 58 == x >> 58:
            continue
        after = r[(i + 1) % len(r)]
        pair = [x >> 28] if len(r) == 1 else [x >> 28, after >> 28] if after & low > x & low else [after >> 28, x >> 28]
        parts[x >> 58] = f"{chain_(pair) >> 32 | 1:08x}"
    return "".join(parts)


def test_fingerprints_are_recomputed(spark, corpus):
    """Occurrences in order of place, two smallest a bin, tuples hashed: each fingerprint against plain Python."""
    rows = [(i, t) for i, (_, t, *_) in enumerate(corpus) if len(t or "") < 20_000] + [(900, "a " * 40), (901, "one two"), (902, "a b c d e"), (903, " x \t y ")]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == signature(t or ""), (i, (t or "")[:60])


def test_fingerprint_is_order_minhash(spark):
    """Against a plain version that shares the hashes' order only in spirit: likeness falls with edits and with moved halves."""
    rng = random.Random(2)
    w = [f"w{rng.randrange(3000)}" for _ in range(600)]
    swapped, edited, far = w[300:] + w[:300], list(w), [f"v{i}" for i in range(600)]
    for i in range(0, 600, 60):
        edited[i] = "new"
    rows = [(i, " ".join(x)) for i, x in enumerate((w, w, edited, swapped, far))]
    df = fingerprints.fingerprint(spark.createDataFrame(rows, "i long, t string"), "t", "f")
    f = {r["i"]: r["f"] for r in df.collect()}

    def like(a, b):
        filled = [(x, y) for x, y in zip(f[a], f[b], strict=True) if x or y]
        return sum(x == y for x, y in filled) / len(filled)

    assert like(0, 1) == 1 and like(0, 4) == 0 and 1 > like(0, 2) > 0.5 and like(0, 3) < 1


def test_occurrences_are_numbered(spark):
    rows = [(1, "a " * 40), (2, "a " * 80)]
    f = {r["i"]: r["f"] for r in fingerprints.fingerprint(spark.createDataFrame(rows, "i long, t string"), "t", "f").collect()}
    assert sum(x != 0 for x in f[1]) > 10 and f[1] != f[2]


def test_token_ids(docs, corpus, vocabulary, library, none):
    got = binary.op9(docs).collect()
    assert len(got) == len(corpus)
    rows = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = collections.Counter(), 0
    for i, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[(i, start, len(ids), zlib.crc32(ids.tobytes()))] += 1
        start += len(ids)
    assert collections.Counter(map(tuple, got)) == want
    assert binary.op9(none).count() == 0
    enc = binary.Encoder(vocabulary)
    ids, n = enc.encode(pa.array(HARD), [2])
    assert ids.tolist() == [x for t in HARD for x in [*library.encode(t, add_special_tokens=False).ids, 2]] and n.sum() == len(ids)


def test_pre_tokens_are_kept_not_chunks(vocabulary, library, monkeypatch):
    """The table has a word once, whatever signs and lines follow it; chunks of odd or long parts, a full table and planes in stretches."""
    enc = binary.Encoder(vocabulary)
    words, ends = [f"{a}{b}é"[:n] for a in ("wor", "Vel") for b in ("den", "tur") for n in (3, 6, 7)], ["", ".", ",", "!?", ");", "\nand", ".\nVel;", "'s", " ", "\n"]
    texts = [" ".join(w + e for w in words for e in ends), None, "", *(w + e for w in words for e in ends), "x" * 70 + " " + "y" * 70 + ". " + "z" * 63 + ".", "a1 b2\n\nc d\te"]
    want = [x for t in texts for x in [*library.encode(t or "", add_special_tokens=False).ids, 2]]
    texts = pa.array(texts)
    for kept in (binary.KEPT, 3):
        monkeypatch.setattr(binary, "KEPT", kept)
        for _ in range(2):
            ids, n = enc.encode(texts, [2])
            assert ids.tolist() == want and n.sum() == len(want)
            assert len(enc.number) < 60 and all(len(x) <= binary.LONGEST + 1 for x in enc.number)
    enc.encode(pa.array([" ".join(w + "-" * i for w in words for i in range(1, 40))]), [2])
    assert len(enc.number) < 110  # 468 chunks
    monkeypatch.setattr(binary, "PARTED", 7)
    matrix = binary.WaveletMatrix.build(ids, 16)
    assert matrix.decode().tolist() == want and [matrix.access(i) for i in range(50)] == want[:50]


def test_token_ids_in_many_shards(spark, vocabulary, library, tmp_path):
    """Shards of few texts, a text longer than a shard by itself, null and repeated ids: files, sizes and the whole read back."""
    rows = [(i, f"text {i} " * 40) for i in range(205)] + [(100, "long one " * 2000), (None, "no id"), (7, "again"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "ids")
    binary.write_shards(df, vocabulary, path, shard_text=3000)
    size = {}
    for r in spark.read.parquet(path).collect():
        shard = binary.Shard.from_bytes(bytes(r["payload"]))
        size[(r["first_doc"], r["last_doc"], r["seq"])] = len(shard.doc_ids), r["n_tokens"]
    assert len(size) >= 205 * 350 // 3000
    assert [n for n, tokens in size.values() if tokens > 3000] == [1]
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["start"], r["n_tokens"], r["ids_crc32"]) for r in binary.read_shards(spark, path).collect())
    start, n, total = 0, 0, 0
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[(i is not None, i or 0), len(ids), zlib.crc32(ids.tobytes())] += 1
        total += len(ids)
    assert collections.Counter((k, n, c) for k, _, n, c in got) == want
    for _, at, n, _ in sorted(got, key=lambda x: x[1]):
        assert at == start
        start += n
    assert start == total and [k for k, *_ in sorted(got, key=lambda x: x[1])] == [k for k, *_ in got]


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 50_257, 3000), rng.integers(0, 5, 9000)]).astype(np.uint16)
    raw = binary.Shard([1, None, -3], np.array([5, 0, len(ids) - 5], np.uint32), binary.WaveletMatrix.build(ids, 16)).to_bytes()
    shard = binary.Shard.from_bytes(raw)
    m = shard.matrix
    assert shard.doc_ids == [1, None, -3] and (m.decode() == ids).all()
    for i in rng.integers(0, len(ids), 60).tolist():
        t = int(ids[i])
        before = int((ids[:i] == t).sum())
        assert m.access(i) == t and m.rank(t, i) == before and m.select(t, before) == i and m.count(t) == (ids == t).sum()
    assert m.count(65_535) == 0 and binary.WaveletMatrix.build(ids[:0], 16).decode().tolist() == []
    with pytest.raises(IndexError):
        m.select(int(ids[0]), 10**6)
    with pytest.raises(ValueError):
        binary.Shard.from_bytes(b"nothing at all")


def test_shards(docs, corpus, none):
    got = sharding.op10(docs).collect()
    assert len(got) == len(corpus) and {r["law"] for r in got} == {"bytes"}
    slots, bytes_ = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
    assert set(slots) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    place = collections.defaultdict(set)
    by = {(r["doc_id"], r["size"]): r for r in got}
    for i, t, *_ in corpus:
        r = by[(i, len((t or "").encode()) + 1)]
        assert r["text_crc32"] == zlib.crc32((t or "").encode())
        place[t].add(r["shard"])
    assert all(len(v) == 1 for v in place.values())
    assert sharding.op10(none).count() == 0
    old = docs.withColumns({"shard": F.lit(99), "Slot": F.lit("x")})
    out = sharding.sharded(old)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == sorted((r["shard"], r["slot"]) for r in got)


def tree(units, shards):
    """The k-d tree on the driver: units are (weight, coordinates); the leaf of each unit. Exact weighted quantiles."""
    if shards == 1 or not units:
        return {u: 0 for u in units}
    wide = [max(u[1][d] >> 40 for u in units) - min(u[1][d] >> 40 for u in units) for d in range(4)]
    d = wide.index(max(wide))
    order, left, goal, upto, n = sorted(units, key=lambda u: u[1][d]), shards // 2, sum(u[0] for u in units) * (shards // 2) / shards, 0, 0
    while n < len(order) and upto + order[n][0] < goal:
        upto, n = upto + order[n][0], n + 1
    if n < len(order) and upto + order[n][0] - goal <= goal - upto:
        n += 1
    return tree(order[:n], left) | {u: left + x for u, x in tree(order[n:], shards - left).items()}


@pytest.mark.parametrize(("shards", "bins"), [(8, 1 << 14), (5, 16), (1, 16)])
def test_shards_are_the_trees(spark, monkeypatch, shards, bins):
    """Widest dimensions and weighted medians against a tree built from all units at once."""
    monkeypatch.setattr(sharding, "BINS", bins)
    monkeypatch.setattr(sharding, "FINE", 0.0)
    rng = random.Random(shards)
    rows = [(i, "x" * int(2 ** rng.uniform(0, 9)) + str(i // 2), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    text = F.col("text")
    units = sharding.groups(docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")), 0, 199).collect()
    want = {r["t1"]: None for r in units}
    by = {(r["weight"], tuple(r[d] for d in sharding.DIMENSIONS), r["t1"]): r["t1"] for r in units}
    for u, leaf in tree(list(by), shards).items():
        want[by[u]] = leaf
    got = {r["t1"]: r["shard"] for r in sharding.shard(docs, shards).collect()}
    assert got == want and len(set(got.values())) == shards


def test_shards_of_target_bytes(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 50, "en", "s") for i in range(100)], DOCS.replace(", n_chars long", ""))
    got = sharding.shard(docs, None, 4000).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(got) == 4 and max(r["s"] for r in got) < 5000
    one = spark.createDataFrame([(None, "a" * 300_000, None, None), (None, None, None, None), (None, "", None, None)], DOCS.replace(", n_chars long", ""))
    assert sharding.shard(one, None, 4000).count() == 3


def test_shards_are_even(spark):
    docs = base.load(spark, "/root/testdata/sf0.01", "documents")
    sizes = [r["s"] for r in sharding.op10(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.15  # groups are large here


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES] == list(range(1, 11))


def test_a_cluster_needs_a_shared_folder():
    class session:  # noqa: N801
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, getCheckpointDir = "local-cluster[2,1,1024]", staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        base.shared_dir(session)


def test_offsets_in_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(-5000, 5000)]), i, rng.randrange(9)) for i in range(400)]
    got = {r["b"]: r["before"] for r in base.offsets(base.park(spark.createDataFrame(rows, "a long, b long, n long")), ["a", "b"], "n", "before").collect()}
    total = 0
    for _, b, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        assert got[b] == total
        total += n

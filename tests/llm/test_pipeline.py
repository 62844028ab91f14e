"""The pipeline's stages: each against its operator's own result, on a small table."""

from __future__ import annotations

import collections
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from jobtide.llm import base, decontamination, jaccard, mixing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = base.load(spark, SF, "documents")
    now, seen = docs, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = base.park(stage(spark, now, SF))
        seen.append(out)
        assert out.columns == docs.columns + (["shard", "slot"] if i == len(corpus_pipeline.STAGES) - 1 else [])
        now = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    scores = {r["doc_id"]: r["predicted"] for r in quality.op3(docs, base.load(spark, SF, "labels")).collect()}
    assert ids(seen[0]) == {i for i, p in scores.items() if p}
    assert ids(seen[1]) == {r["component_id"] for r in jaccard.join(seen[0], 5, 80).collect()}
    leaks = ids(decontamination.matches(seen[1], base.load(spark, SF, "benchmark")))
    assert ids(seen[2]) == ids(seen[1]) - leaks
    assert ids(seen[3]) <= ids(seen[2]) and seen[4].count() == seen[3].count()
    assert corpus_pipeline.run(spark, SF).count() == seen[4].count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing names, stage by stage against plain Python."""
    known = base.load(spark, SF, "documents").limit(60).collect()
    items = [r["text"] for r in base.load(spark, SF, "benchmark").limit(3).collect()]
    good = max((r["text"] for r in known if r["lang"] == "en"), key=len)
    rows = [tuple(r) for r in known]
    rows += [(9001, None, "en", "a", None), (9002, "", None, None, 0), (9003, " \t\n", "en", "a", 3), (None, good, "en", "a", 1), (None, None, None, None, None), (9004, good, None, None, None), (9004, good, None, None, None)]
    rows += [(9004, good + " and more", "de", "b", 1), (9005, (good + " ") * 40, "en", "a", 1), (9006, good[:900] + " " + items[0] + " " + good[900:], "en", "b", 1), (9007, "word " * 60_000, "en", "c", 1)]
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    clash = {c: F.lit(7) for c in ("row", "score", "gone", "key", "r", "c", "bad", "copies", "Shard", "slot", "i", "j", "t1", "h1", "d", "_d", "stays", "size")}
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash).repartition(3)
    columns, plain = now.columns, lambda df: collections.Counter(tuple(r[c] for c in names) for r in df.collect())
    labels, bench = base.load(spark, SF, "labels"), base.load(spark, SF, "benchmark")
    stages, before = [f for _, f in corpus_pipeline.STAGES], plain(now)

    out = base.park(stages[0](spark, now, SF))
    model = quality.fit(now, labels)
    want = collections.Counter({r: n for r, n in before.items() if model.scores(np.array([quality.features(r[1])]))[0] >= quality.THRESHOLD})
    assert out.columns == columns and plain(out) == want

    # near copies, over all rows so that the odd ones are among them
    out = base.park(stages[1](spark, now, SF))
    grams = [frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if grams[i] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    stay = collections.Counter()
    for g in set(group):
        of = [rows[i] for i in range(len(rows)) if group[i] == g]
        numbered = sorted((r for r in of if r[0] is not None and r[1] and r[1].split()), key=lambda r: r[0])
        stay.update([r for r in of if r not in numbered])
        if numbered:
            assert any(plain(out)[r] == 1 for r in numbered if r[0] == numbered[0][0])
            stay.update([next(r for r in numbered if r[0] == numbered[0][0] and plain(out)[r])])
    assert out.columns == columns and plain(out) == stay

    out = base.park(stages[2](spark, now, SF))
    index = decontamination.Index([(r["item_id"], r["text"]) for r in bench.collect()])
    leaks = lambda t: bool(t) and any(index.search(decontamination.letters(decontamination.fold(t)[s : s + 5000])) for s in range(0, len(t), 4000))
    assert out.columns == columns and plain(out) == collections.Counter({r: n for r, n in before.items() if not leaks(r[1])}) and sum(leaks(r[1]) for r in rows) > 0

    out = base.park(stages[3](spark, now, SF))
    taken = plain(out)
    assert out.columns == columns and set(taken) <= set(before) and all(n <= 2 * before[r] for r, n in taken.items())
    picks = collections.Counter()
    for r in mixing.copies(now).collect():
        picks[r["doc_id"], r["source"], r["size"]] += r["copies"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter({k: n for k, n in picks.items() if n}) == sum((collections.Counter({(r[0], r[3], size(r[1])): n}) for r, n in taken.items()), collections.Counter())

    out = base.park(stages[4](spark, now, SF))
    assert out.columns == [c for c in columns if c.lower() not in ("shard", "slot")] + ["shard", "slot"] and plain(out) == before
    slots = collections.defaultdict(list)
    for r in out.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len({r["shard"] for r in out.collect() if r["text"] == good}) == 1


def test_empty(spark):
    now = base.load(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = base.park(stage(spark, now, SF))
        assert now.count() == 0

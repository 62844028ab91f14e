"""Queries of the training-data operators that are to take all their rows, and cases that a plainer form would lose."""

from __future__ import annotations

import random

from jobtide.llm import decontamination, fingerprints, jaccard, langid


def test_every_quote_of_a_long_item_is_found():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    filler = " ".join(word() for _ in range(40))
    for size in (110, 125, 394):
        item = " ".join(word() for _ in range(size))[:size].strip() + "."
        index = decontamination.Index([(1, item)])
        least = decontamination.QUOTE + decontamination.STRIDE - 1
        for n in (least, 100, 140):
            for s in range(len(item) - n + 1):
                assert index.search(decontamination.letters(decontamination.fold(f"{filler} {item[s : s + n]} {filler}"))), (size, n, s)
        assert not index.search(decontamination.letters(filler))


def test_fingerprints_of_short_texts_carry_order(spark):
    """Of 20 k-mers, 16 stay when the halves change places; of the pairs of them, about half are turned round."""
    rows = []
    for i in range(40):
        first, second = ([f"w{i}x{j}" for j in r] for r in (range(12), range(12, 24)))
        rows += [(i, 0, " ".join(first + second)), (i, 1, " ".join(second + first))]
    f = {(r["i"], r["s"]): r["f"] for r in fingerprints.fingerprint(spark.createDataFrame(rows, "i long, s int, t string"), "t", "f").collect()}
    both = [[(x, y) for x, y in zip(f[i, 0], f[i, 1], strict=True) if x or y] for i in range(40)]
    assert sum(sum(x == y for x, y in b) / len(b) for b in both) / 40 < 0.45


def test_every_labelled_language_is_kept(spark):
    rng = random.Random(7)
    words = {f"l{i:02}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for i in range(70)}
    text = lambda x: " ".join(rng.choice(words[x]) for _ in range(30))
    rows = [(100 * i + j, x, text(x)) for i, x in enumerate(words) for j in range(2 if x == "l69" else 4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), rows=20)
    assert model.languages == sorted(words)
    assert all(model.languages[int(model.likelihood(text(x)).argmax())] == x for x in words)
    pages = spark.createDataFrame([(i, f"http://h{i}.example/", f"<p>{text(x)}") for i, x in enumerate(words)], "page_id long, url string, html string")
    assert {r["page_id"]: r["lang"] for r in langid.identify(pages, model).collect()} == dict(enumerate(words))


def test_repeated_ids_go_row_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, c + " end"), (3, c), (None, a)]
    kept = jaccard.one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "a"), (1, "a"), (2, "b"), (3, "c")]

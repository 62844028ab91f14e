"""Language identification by Bayesian fusion of evidence.

The posterior of a page's language is proportional to
  the likelihood of its visible text (letter trigrams, multinomial, tempered to EFFECTIVE trigrams at most),
  the probability of the language declared in its markup, given the language,
  the probability of its address's suffix and path code, given the language,
  the prior of its host, smoothed towards its domain's, which is smoothed towards the whole table's.
The tables of the last three are grouped sums of the posteriors that the texts alone give, over all pages; a page's own share
is taken out of its host's and domain's. Sums are pre-aggregated by Spark, so a hot host costs no more than others.

The trigram model is fitted on about FIT_ROWS labelled documents, chosen by a hash of doc_id (a documented bound), and on about LEAST of
each language at least, or all it has. Every labelled language is kept.

Defined results: a page without text, declaration and known host gets the prior's language; a null url or markup is no evidence; ties
go to the first language by name; without labelled documents every language is null; repeated rows are judged each; a page of any length is
judged whole; an empty table gives an empty table; extra columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import MAX_SMALL, broadcast_if_small, discard, park, ship
from .decontamination import letters
from .html import render

FIT_ROWS, LEAST, BUCKETS, EFFECTIVE, SMOOTH, PULL = 8_000, 50, 1 << 16, 40.0, 0.5, 5.0

_HTML_LANG = re.compile(r"<html\b[^>]*?\slang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
_META_LANG = re.compile(r"<meta\b[^>]*http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*content\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)
_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)(?::\d+)?(?:/([^/?#]*))?")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the letter trigrams of the lowered words, with a space at each end."""
    x = letters(" " + " ".join(text.lower().split()) + " ").astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    h = (x[:-2] * np.uint64(0x9E3779B1) + x[1:-1]) * np.uint64(0x85EBCA77) + x[2:]
    h = (h ^ (h >> np.uint64(15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


class Model:
    """Log probabilities of the trigrams in each language, and the languages' log shares."""

    def __init__(self, languages: list[str], counts: np.ndarray, share: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTH
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
        self.share = share / share.sum()

    def likelihood(self, text: str | None) -> np.ndarray:
        """Log likelihoods, tempered, with the largest at 0."""
        t = trigrams(text or "")
        if not len(t):
            return np.zeros(len(self.languages))
        out = self.log[:, t].mean(1).astype(float) * min(len(t), EFFECTIVE)
        return out - out.max()


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter(docs["lang"].isNotNull() & docs["text"].isNotNull()).select(docs["doc_id"].cast("long").alias("id"), docs["lang"].cast("string").alias("lang"), docs["text"])
    shares = known.groupBy("lang").count().collect()  # a row a language
    if not shares:
        return None
    languages = sorted(r["lang"] for r in shares)
    total = sum(r["count"] for r in shares)
    upto = spark.createDataFrame([(r["lang"], max(1, int(min(1.0, max(rows / total, LEAST / r["count"])) * 1_000_000))) for r in shares], "lang string, upto long")
    part = known.join(F.broadcast(upto), "lang").filter(F.pmod(F.xxhash64(F.lit(13), "id"), F.lit(1_000_000)) < F.col("upto"))

    def sums(batches):
        at = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[at[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        lang, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang, bucket])], ["lang", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS))
    for r in part.select("lang", "text").mapInArrow(sums, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # BUCKETS rows a language at most
        counts[r["lang"], r["bucket"]] = r["n"]
    share = {r["lang"]: r["count"] for r in shares}
    return Model(languages, counts, np.array([share[x] for x in languages], float))


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """Host, domain (the last two labels) and suffix: the last label, and the first part of the path if it is a two-letter code."""
    m = _URL.match(url or "")
    if not m:
        return None, None, None
    host = m[1].lower().strip(".")
    labels = host.split(".")
    code = (m[2] or "").lower()
    return host, ".".join(labels[-2:]), labels[-1] + ("/" + code if len(code) == 2 and code.isalpha() else "")


def declared(markup: str | None) -> str | None:
    m = markup and (_HTML_LANG.search(markup) or _META_LANG.search(markup))
    return m[1].lower() if m else None


def identify(pages: DataFrame, model: Model | None) -> DataFrame:
    """One row a page: page_id, lang, confidence, text_lang (the text's alone; null without text), declared, host."""
    spark = pages.sparkSession
    ship(spark)
    if model is None:
        null = F.lit(None).cast("string")
        return pages.select(pages["page_id"].cast("long").alias("page_id"), null.alias("lang"), F.lit(0.0).alias("confidence"), null.alias("text_lang"), null.alias("declared"), null.alias("host"))
    names, L = model.languages, len(model.languages)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats a language

    def lists(rows: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, L), pa.int32()), pa.array(rows.ravel()))

    def run(batches):
        m = shared.value
        for b in batches:
            urls, markups = b.column(1).to_pylist(), b.column(2).to_pylist()
            texts = [render(x) for x in markups]
            parts = [address(u) for u in urls]
            like = np.array([m.likelihood(t) for t in texts], float).reshape(-1, L)
            raw = np.exp(like) * m.share
            post = raw / raw.sum(1, keepdims=True)
            cols = [b.column(0), *[pa.array([p[i] for p in parts], pa.string()) for i in range(3)], pa.array(list(map(declared, markups)), pa.string()), lists(like), lists(post), pa.array([bool(t) for t in texts])]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "domain", "suffix", "declared", "like", "post", "has_text"])

    cols = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string"), pages["html"].cast("string"))
    seen = park(cols.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, like array<double>, post array<double>, has_text boolean"))
    shared.destroy()
    sums = [F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(L)]
    vector = F.array(*[f"s{i}" for i in range(L)])

    def table(keys: list[str], name: str) -> DataFrame:
        return park(seen.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(*sums).select(*keys, vector.alias(name)))

    hosts, domains, suffixes, marks = table(["host", "domain"], "by_host"), table(["domain"], "by_domain"), table(["suffix"], "by_suffix"), table(["declared"], "by_mark")
    every = np.array([x or 0.0 for x in seen.agg(*sums).first()])  # a number a language
    kinds = {"by_suffix": suffixes.count(), "by_mark": marks.count()}
    x = seen.join(broadcast_if_small(hosts, MAX_SMALL), ["host", "domain"], "left").join(broadcast_if_small(domains, MAX_SMALL), ["domain"], "left")
    x = x.join(broadcast_if_small(suffixes, MAX_SMALL), ["suffix"], "left").join(broadcast_if_small(marks, MAX_SMALL), ["declared"], "left")

    def fuse(batches):
        for b in batches:
            page, mark, host = b.columns[:3]
            has_text = b.column(3).to_numpy(zero_copy_only=False)
            sums_of = {}
            for name, c in zip(("like", "post", "by_host", "by_domain", "by_suffix", "by_mark"), b.columns[4:], strict=True):
                there = c.is_valid().to_numpy(zero_copy_only=False)
                sums_of[name] = np.zeros((b.num_rows, L))
                sums_of[name][there] = c.flatten().to_numpy(zero_copy_only=False).reshape(-1, L)
                sums_of[f"{name}?"] = there
            score = scores(sums_of, every, kinds)
            top = score.max(1, keepdims=True)
            best = score.argmax(1) if b.num_rows else np.zeros(0, int)
            text = sums_of["like"].argmax(1) if b.num_rows else best
            cols = [page, pa.array([names[i] for i in best], pa.string()), pa.array(1 / np.exp(score - top).sum(1)), pa.array([names[i] if t else None for i, t in zip(text, has_text, strict=True)], pa.string()), mark, host]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "lang", "confidence", "text_lang", "declared", "host"])

    out = x.select("page_id", "declared", "host", "has_text", "like", "post", "by_host", "by_domain", "by_suffix", "by_mark")
    out = park(out.mapInArrow(fuse, "page_id long, lang string, confidence double, text_lang string, declared string, host string"))
    discard(seen, hosts, domains, suffixes, marks)
    return out


def scores(x: dict[str, np.ndarray], every: np.ndarray, kinds: dict[str, int]) -> np.ndarray:
    """Log posteriors but for a constant, a row a page: like and post of its text, and the sums of its host, domain, suffix and declaration
    (zeros where there is none), of which its own share is taken out; every has the sums of all pages, kinds how many suffixes and
    declarations there are."""
    rest = lambda c: np.maximum(x[c] - x["post"], 0)
    size = lambda c: np.maximum(x[c].sum(1, keepdims=True) - 1, 0)
    base = (every + SMOOTH) / (every.sum() + SMOOTH * len(every))
    domain = (rest("by_domain") + PULL * base) / (size("by_domain") + PULL)
    host = (rest("by_host") + PULL * domain) / (size("by_host") + PULL)
    out = x["like"] + np.log(host)
    for c, n in kinds.items():
        given = np.log((rest(c) + SMOOTH) / (every + SMOOTH * (n + 1)))
        out += np.where(x[f"{c}?"][:, None], given, 0)
    return out


def op6(pages: DataFrame, docs: DataFrame) -> DataFrame:
    return identify(pages, fit(docs))

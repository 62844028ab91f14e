"""Benchmark decontamination by the q-gram lemma.

Texts are lowered and runs of white space become one space. A benchmark item is cut into windows of QUOTE letters, one every STRIDE
letters, so that each verbatim quote of QUOTE + STRIDE - 1 letters or more holds one; an item of WINDOW letters at most is a window
as a whole besides. A place in a document matches a window of m letters if its edit distance is k = floor(EDITS * m) at most; then it
shares at least m + 1 - (k + 1) Q q-grams with the window, all within k diagonals of each other. So shared q-grams are
counted in bands of 2 k + 2 diagonals (more precisely of a power of two that is as large), each of which overlaps the next by half;
regions below the bound go, the others are verified by a banded alignment, free at both ends in the document.

Documents are scanned once, whole, in Arrow batches, whatever the benchmark's size: bitmaps of all of the benchmark's q-grams (of
bounded size, put together by the executors) leave the stretches that hold as many known q-grams as any window asks for. The lemma holds
for any q, so the bitmaps are of longer q-grams, which fewer other texts share, where the windows are long enough to ask for one. These
pieces of text are parked and searched with the windows themselves, whose texts travel in slices of SLICE letters; a larger
benchmark takes more passes over the pieces, which are few.

Defined results: null and empty texts match nothing; an item without a q-gram's length of letters matches nothing; equal items are
reported each; repeated rows are reported each; ties between places go to the first; a text of any length is scanned whole, in parts that
overlap by more than a window and its edits; an empty table on either side gives an empty table; extra columns are not looked at, and stay in
clean, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import MAX_SMALL, broadcast_if_small, discard, park, releasing, ship

Q, WINDOW, QUOTE, STRIDE, EDITS, SLICE = 8, 120, 60, 15, 0.08, 1 << 19
#: Bits of the bitmap's places at least and at most, bytes of one of its blocks, letters that are scanned at once, slices whose finds are
#: put together at once.
FILTER, MOST, BITMAP_BLOCK, AT_ONCE, TOGETHER = 22, 28, 1 << 16, 1 << 18, 16
#: Lengths of windows that share a bound, up to each; the lengths of q-grams that the bitmaps know; the letters around a stretch that an
#: alignment may look at; blanks between pieces that are searched together, more than a band spans.
LENGTHS, LONGER, AROUND, APART = (11, 15, 23, 31, 47, 59, QUOTE, 90, WINDOW), 10, 80, 200
_BASE, _SPREAD = 0x5851F42D4C957F2D, np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """The hash of the q-gram at each place."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    h, size, power = x.astype(np.uint64), 1, _BASE
    n = len(x) - q + 1
    while size < q:  # h has the hashes of size letters; q is a power of two
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    h = h[:n]
    h *= _SPREAD
    h ^= h >> np.uint64(29)
    return h


def allowed(m: int, edits: float = EDITS) -> int:
    return int(edits * m)


def needed(m: int, k: int, q: int = Q) -> int:
    """The least number of shared q-grams of a window of m letters with a place at distance k."""
    return m + 1 - (k + 1) * q


def distance(window: np.ndarray, place: np.ndarray, k: int) -> tuple[int, int]:
    """The least edit distance of the window to a part of place that begins anywhere, and where that part ends; k + 1 if it
    is over k. A row of the alignment for each letter of the window; only cells that can stay at k count."""
    n, big = len(place), k + 1
    row = np.zeros(n + 1, np.int32)
    at = np.arange(n + 1, dtype=np.int32)
    for i, c in enumerate(window, 1):
        new = np.empty(n + 1, np.int32)
        new[0] = i
        np.minimum(row[:-1] + (place != c), row[1:] + 1, out=new[1:])
        new = np.minimum.accumulate(new - at) + at  # insertions along the row
        row = np.minimum(new, big)
        if row.min() >= big:
            return big, 0
    end = int(row.argmin())
    return int(row[end]), end


def windows(x: np.ndarray, window: int = WINDOW, quote: int = QUOTE, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Where the windows of an item of these letters begin and end."""
    parts = [(0, len(x))] if len(x) <= window else []
    if len(x) > quote:  # the second last start, too: of any window of two quotes' length, one half has half the edits at most
        parts += [(s, s + quote) for s in sorted({*range(0, len(x) - quote, stride), max(0, len(x) - 2 * quote), len(x) - quote})]
    return [(s, e) for s, e in parts if needed(e - s, 0) > 0]


def slack_of(m: int, q: int = Q, edits: float = EDITS) -> int:
    """The edits of a window of m letters: fewer where the lemma would not ask for a q-gram."""
    k = allowed(m, edits)
    while k and needed(m, k, q) < 1:
        k -= 1
    return k


class Index:
    """The windows of some items."""

    def __init__(self, items: list[tuple[int, str]], quote: int = QUOTE):
        self.windows, hashes, owners, places = [], [], [], []
        for item, text in items:
            x = letters(fold(text))
            for s, e in windows(x):
                part = x[s:e]
                k = slack_of(len(part))
                h = grams(part)
                owners.append(np.full(len(h), len(self.windows)))
                hashes.append(h)
                places.append(np.arange(len(h)))
                self.windows.append((item, s, part, k, needed(len(part), k)))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        h = join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash, self.owner, self.place = h[order], join(owners, np.int32)[order], join(places, np.int16)[order]
        self.filter = np.zeros(1 << FILTER, bool)
        self.filter[(self.hash >> np.uint64(64 - FILTER)).astype(np.int64)] = True
        self.need = np.array([w[4] for w in self.windows], np.int64)
        self.slack = np.array([w[3] for w in self.windows], np.int64)
        #: Half a band as a power of two of at least k + 1 diagonals, so that two neighbouring halves hold any k + 1 of them.
        self.shift = np.array([int(k).bit_length() for k in self.slack], np.int64)

    def search(self, x: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(window, start, end, distance) of the matching places in x, one a window and region."""
        return [m[1:] for m in self.search_all([x])]

    def search_all(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(text, window, start, end, distance) of the matching places in texts, which are searched as one, set apart by more letters than a
        band spans."""
        blank = np.zeros(APART, np.uint32)
        begins = np.cumsum([0, *(len(t) + APART for t in texts)])
        x = np.concatenate([y for t in texts for y in (t, blank)]) if texts else blank
        h = grams(x)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER)).astype(np.int64)])
        if not self.windows or len(at) < self.need.min():
            return []
        h = h[at]
        low, high = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = high - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        if not len(at):
            return []
        hit = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, place, spot = self.owner[hit].astype(np.int64), self.place[hit].astype(np.int64), np.repeat(at, n)
        half = (spot - place + 4096) >> self.shift[owner]
        # a hit counts in the two bands that its half belongs to
        keys = np.concatenate((owner << 40 | half, owner << 40 | (half - 1)))
        firsts = np.concatenate((spot - place, spot - place))
        spots = np.concatenate((spot, spot))
        order = np.argsort(keys, kind="stable")
        keys, firsts, spots = keys[order], firsts[order], spots[order]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(edge, len(keys)))
        good = count >= self.need[keys[edge] >> 40]
        out = []
        for e in edge[good].tolist():
            w = int(keys[e] >> 40)
            _, _, part, k, _ = self.windows[w]
            text = int(np.searchsorted(begins, spots[e], "right")) - 1
            first, last = int(begins[text]), int(begins[text]) + len(texts[text])
            s = int(firsts[e])
            if s >= first and s + len(part) <= last and np.array_equal(x[s : s + len(part)], part):  # verbatim
                out.append((text, w, s - first, s - first + len(part), 0))
                continue
            band = int(keys[e] & ((1 << 40) - 1))
            begin = max(first, (band << int(self.shift[w])) - 4096 - k)
            end = min(last, ((band + 2) << int(self.shift[w])) - 4096 + len(part) + k)
            d, stop = distance(part, x[begin:end], k)
            if d <= k:
                out.append((text, w, max(0, begin - first + stop - len(part)), begin - first + stop, d))
        return out


def short_grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of 32 bits of the q-gram at each place, for the bitmaps; x has q letters at least."""
    out, done, h, size, power = None, 0, x, 1, 0x4C957F2D  # h has the hashes of size letters, out those of the last done letters
    while True:
        if q & size:
            out = h if out is None else h[: len(h) - done] * np.uint32(pow(0x4C957F2D, done, 1 << 32)) + out[size:]
            done += size
        if 2 * size > q:
            break
        h = h[:-size] * np.uint32(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 32)
    out = out * np.uint32(0x9E3779B1)
    return out ^ (out >> np.uint32(15))


class Known:
    """Bitmaps of a benchmark's q-grams, and for some lengths of windows q, the least number of known q-grams and the letters that hold them."""

    def __init__(self, bits: int, bitmaps: dict[int, np.ndarray], lengths: list[int]):
        self.bits, self.bitmaps, self.least = bits, bitmaps, {}
        low = 0
        for high in LENGTHS:
            of = [m for m in lengths if low < m <= high]
            if of:
                q = LONGER if min(needed(m, slack_of(m), LONGER) for m in of) > 0 else Q
                self.least.setdefault(q, []).append((min(needed(m, slack_of(m), q) for m in of), max(m + slack_of(m) for m in of)))
            low = high

    def dense(self, x: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of x that may hold a match, each with the letters around it that an alignment may look at."""
        found = []
        for q, classes in self.least.items():
            if len(x) < q:
                continue
            h = short_grams(x, q) >> np.uint32(32 - self.bits)
            seen = (self.bitmaps[q][h >> np.uint32(3)] >> (h & np.uint32(7)).astype(np.uint8)) & np.uint8(1)
            upto = np.zeros(len(seen) + 1, np.int32)
            np.cumsum(seen, out=upto[1:])
            for least, reach in classes:
                stretch = min(reach, len(seen))
                starts = np.flatnonzero(upto[stretch:] - upto[:-stretch] >= least) if upto[-1] >= least else ()
                if len(starts):  # runs of starts, one stretch each
                    cut = np.flatnonzero(np.diff(starts) > 2 * AROUND + stretch) + 1
                    found += [(int(r[0]) - AROUND, int(r[-1]) + stretch + q + AROUND) for r in np.split(starts, cut)]
        return _merged([(max(0, s), min(len(x), e)) for s, e in found])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def known(benchmark: DataFrame) -> Known:
    """The bitmaps of the items, of 2 ** MOST bits at most each; about 16 bits a letter where that is less."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST, max(FILTER, math.ceil(math.log2(16 * total + 1))))
    size = (1 << bits) // 8

    def mark(batches):
        bitmaps, lengths = {q: np.zeros(size, np.uint8) for q in (Q, LONGER)}, set()
        for b in batches:
            for text in b.column(0).to_pylist():
                x = letters(fold(text))
                lengths |= {e - s for s, e in windows(x)}
                for q, bitmap in bitmaps.items():
                    if len(x) >= q:
                        h = short_grams(x, q) >> np.uint32(32 - bits)
                        np.bitwise_or.at(bitmap, h >> np.uint32(3), np.uint8(1) << (h & np.uint32(7)).astype(np.uint8))
        rows = [(0, m, None) for m in sorted(lengths)]
        for q, bitmap in bitmaps.items():
            rows += [(q, i // BITMAP_BLOCK, bitmap[i : i + BITMAP_BLOCK].tobytes()) for i in range(0, size, BITMAP_BLOCK) if bitmap[i : i + BITMAP_BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["q", "i", "block"])

    def unite(batches):
        blocks: dict = {}
        for b in batches:
            for q, i, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                blocks[q, i] = raw and np.frombuffer(raw, np.uint8) | blocks.get((q, i), np.uint8(0))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in blocks], pa.int32()), pa.array([k[1] for k in blocks], pa.int32()), pa.array([v if v is None else v.tobytes() for v in blocks.values()], pa.binary())], ["q", "i", "block"])

    bitmaps, lengths = {q: np.zeros(size, np.uint8) for q in (Q, LONGER)}, set()
    schema = "q int, i int, block binary"
    for r in benchmark.select(benchmark["text"]).mapInArrow(mark, schema).repartition("q", "i").mapInArrow(unite, schema).collect():  # the bitmaps and WINDOW rows
        if r["block"] is None:
            lengths.add(r["i"])
        else:
            bitmaps[r["q"]][r["i"] * BITMAP_BLOCK : (r["i"] + 1) * BITMAP_BLOCK] = np.frombuffer(r["block"], np.uint8)
    out = Known(bits, bitmaps, sorted(lengths))
    out.bitmaps = {q: bitmaps[q] for q in out.least}
    return out


def pieces(of: Known, texts: list[str | None]) -> list[list[tuple[int, str]]]:
    """Of each text the stretches that may hold a match: where they begin in the folded text, and what they are."""
    folded = [fold(t) for t in texts]
    out: list[list] = [[] for _ in texts]
    held: list[tuple[int, int, int]] = []  # document, start, end

    def scan():
        if not held:
            return
        x = letters("\0".join(folded[d][s:e] for d, s, e in held))
        place = np.cumsum([0, *(e - s + 1 for _, s, e in held)])
        for low, high in of.dense(x):
            first, last = np.searchsorted(place, [low, high - 1], "right") - 1
            for i in range(first, min(last, len(held) - 1) + 1):
                d, s, e = held[i]
                begin = max(low - int(place[i]), 0)
                end = min(high - int(place[i]), e - s)
                if end - begin >= Q:
                    out[d].append((s + begin, s + end))
        held.clear()

    size = 0
    for d, t in enumerate(folded):
        for s in range(0, max(1, len(t)), AT_ONCE):  # parts overlap by more than a window and its edits
            begin, end = max(0, s - 2 * WINDOW), min(len(t), s + AT_ONCE)
            held.append((d, begin, end))
            size += end - begin
            if size >= AT_ONCE:
                scan()
                size = 0
    scan()
    return [[(s, folded[d][s:e]) for s, e in _merged(spans)] for d, spans in enumerate(out)]


def slices(benchmark: DataFrame, size: int = SLICE) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of about size letters; one list is on the driver at a time when they are iterated."""
    now, held = [], 0
    for r in benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"]).orderBy("item_id", "text").toLocalIterator():
        if r["text"]:
            now.append((r["item_id"], r["text"]))
            held += len(r["text"])
        if held >= size:
            yield now
            now, held = [], 0
    if now:
        yield now


def _some(rows: list[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """rows in lists of about AT_ONCE letters."""
    now, size = [], 0
    for r in rows:
        now.append(r)
        size += len(r[2])
        if size >= AT_ONCE:
            yield now
            now, size = [], 0
    if now:
        yield now


#: The index of the slice that this process searched last.
_INDEX: dict[str, Index] = {}


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document and item that match: doc_id, item_id, start and end (in the folded text, of the nearest window), distance,
    windows (how many of the item's match)."""
    spark = docs.sparkSession
    ship(spark)
    filter_ = spark.sparkContext.broadcast(known(benchmark))  # 2 ** MOST bits at most

    def scan(batches):
        for b in batches:
            rows = [(doc, p) for doc, p in zip(b.column(0).to_pylist(), pieces(filter_.value, b.column(1).to_pylist()), strict=True) if p]
            if rows:
                cols = [pa.array([d for d, _ in rows], pa.int64()), pa.array([[s for s, _ in p] for _, p in rows], pa.list_(pa.int32())), pa.array([[t for _, t in p] for _, p in rows], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "at", "texts"])

    cols = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    found = park(cols.mapInArrow(releasing(scan), "doc_id long, at array<int>, texts array<string>"))
    filter_.destroy()
    schema = "doc_id long, item_id long, start int, end int, distance int, windows int"
    out, parked, sent = [], [], []

    def settle():
        if out:
            every = out[0]
            for x in out[1:]:
                every = every.unionByName(x)
            parked.append(park(every))
            out.clear()
            while sent:
                sent.pop().destroy()

    for items in slices(benchmark):
        shared = spark.sparkContext.broadcast(items)  # SLICE letters and the last item
        sent.append(shared)

        def search(batches, shared=shared, name=uuid.uuid4().hex):
            if name not in _INDEX:
                _INDEX.clear()
                _INDEX[name] = Index(shared.value)
            index = _INDEX[name]
            for b in batches:
                docs_, best = b.column(0).to_pylist(), {}
                for held in _some([(i, at, t) for i, (ats, ts) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) for at, t in zip(ats, ts, strict=True)]):
                    for text, w, start, end, d in index.search_all([letters(t) for _, _, t in held]):
                        i, begin, _ = held[text]
                        key, new = (i, index.windows[w][0]), (d, start + begin, end + begin)
                        old = best.get(key)
                        best[key] = (*min(new, old[:3] if old else new), (old[3] if old else set()) | {index.windows[w][1]})
                rows = [(docs_[i], item, s, e, d, len(names)) for (i, item), (d, s, e, names) in sorted(best.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1]))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start", "end", "distance", "windows"])

        out.append(found.mapInArrow(releasing(search), schema))
        if len(out) == TOGETHER:
            settle()
    settle()
    discard(found)
    if not parked:
        return spark.createDataFrame([], schema)
    every = parked[0]
    for x in parked[1:]:
        every = every.unionByName(x)
    return every


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those in which an item's window matches; the columns stay as they are. Rows with a null doc_id are judged by their
    text, as all others are."""
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("doc_id"))
    bad = park(matches(named, benchmark).select(F.col("doc_id").alias("bad")).distinct())
    return named.join(broadcast_if_small(bad, MAX_SMALL), F.col("doc_id") == F.col("bad"), "left_anti").select("row.*")


def op5(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)

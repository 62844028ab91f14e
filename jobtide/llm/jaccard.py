"""N-gram Jaccard join: the blocked sparse product of the document by n-gram incidence matrix with its transpose.

Documents with equal sets of n-grams are one row of the matrix. Rows that can reach the threshold share a column of their prefixes (the
first size - ceil(t * size) + 1 columns of each row, rare columns first), so the rows of each prefix column are a block of
the product. Blocks whose smallest row is the same are one: near copies share many columns, yet meet once. The order of the columns
comes from a sketch of fixed size, whose errors cost time, never a pair.

In a block, pairs whose sizes are too far apart are discarded, and rows whose cells in groups of columns (about as many groups as an eighth of
the cells) can't overlap enough with any other row of the block. The rest bring all their cells: the block's part of the
incidence matrix. Its product with its transpose is accumulated from the rare columns to the common ones; before the common ones
come, and after each slab of them, pairs whose overlap so far plus what is left of the smaller row is below the bound of their sizes are
discarded, and rows without a pair go. What is left at the bound is linked, and a block gives a spanning forest of its links,
never all pairs.

There are two rounds, and one between them if blocks are cut, whatever the data. In the first, a row is in one block, that of its smallest smallest row (and in the one where
it is that row itself), which joins families of near copies at once. In the second, all blocks whose rows are of several components
compare rows of different ones. A block of more than BLOCK cells is cut by size classes (partners are in the same or in neighbouring
ones) and by hash: in the first round each part meets alone, with the smallest row of the block in all of them; in the one between all rows of
the block do so, not only those whose smallest smallest row it is, so that near copies in many large blocks are of one component before every two
parts meet; in the second every two parts whose sizes allow it are a block, but those of one component that is large itself. So no task holds
more than about two parts, and nothing is capped. Columns that many rows hold (by the sketch) are dealt by hash before their smallest row is sought.

Texts: A-Z are lowered; words are runs of anything but space and the characters 9 to 13. Defined results: null or empty texts
and those without words have no n-gram, are linked with nothing and are their own component; with fewer words than n, the whole
sequence is the one n-gram; repeated rows and equal sets are one component; a null doc_id counts as larger than any other; an
empty table gives an empty table; columns other than doc_id and text are not looked at, whatever their names. A very long text is one
row like any other: its cells (8 bytes a distinct n-gram) must fit in a task. Rows are known by 128-bit hashes, n-grams by 64-bit
hashes of words, which are hashed modulo two primes, or by xxh3 from LONG bytes on.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import MAX_SMALL, broadcast_if_small, discard, park, releasing, ship

#: Links whose components one task finds.
EDGES = 1 << 18
#: Counters of the sketch and of one of its blocks, cells of a group of columns in a row's profile, cells that a task gathers before it counts them,
#: bytes of words hashed at once, bytes of a word that is hashed on its own.
SKETCH, SKETCH_BLOCK, PROFILE, GATHERED, AT_ONCE, LONG = 1 << 21, 1 << 14, 8, 1 << 19, 1 << 18, 256
#: Cells of a block (a row counts ROW more), rows of a column that are looked at together, columns of a dense slab, pairs counted at once.
BLOCK, ROW, HOT, SLAB, PAIRS = 1 << 19, 512, 2048, 1024, 1 << 20
#: Two primes and two bases, drawn at random, of the words' hashes.
_PRIMES, _BASES = (2147483647, 2147483629), (1103527590, 723471715)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache(1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo the primes."""

    def table(base: int, prime: int) -> np.ndarray:
        out, done, n = np.ones(AT_ONCE + LONG + 1, np.uint64), 1, AT_ONCE + LONG + 1
        while done < n:  # doubling: x[done + i] = x[i] * base ** done
            out[done : 2 * done] = out[: min(done, n - done)] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
            done *= 2
        return out

    return [(table(b, p), table(pow(b, -1, p), p)) for b, p in zip(_BASES, _PRIMES, strict=True)]


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[3]
    h = (h ^ (h >> np.uint64(29))) * _MIX[4]
    return h ^ (h >> np.uint64(32))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw begin, and their hashes: polynomials of the bytes modulo two primes, from differences of running sums."""
    x = np.frombuffer(raw, np.uint8)
    gap = _SPACE[x]
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    ends = np.flatnonzero(~gap & np.append(gap[1:], True)) + 1
    size = ends - starts
    h = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        if size[i] >= LONG:
            h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
            i += 1
            continue
        j = max(int(np.searchsorted(ends, starts[i] + AT_ONCE, "right")), i + 1)
        long = np.flatnonzero(size[i:j] >= LONG)
        if len(long):
            j = i + int(long[0])
        first, last = int(starts[i]), int(ends[j - 1])
        part = x[first:last].astype(np.uint64)
        part += np.uint64(1)
        for k, (up, down) in enumerate(_powers()):
            prime = np.uint64(_PRIMES[k])
            upto = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=upto[1:])  # below 2^9 * 2^31 * 2^21
            one = (upto[ends[i:j] - first] - upto[starts[i:j] - first]) % prime * down[starts[i:j] - first] % prime
            h[i:j] = h[i:j] << np.uint64(32) | one
        i = j
    return starts, _stir(h + size.astype(np.uint64) * _MIX[2])


def rows_of(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-grams."""
    parts = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    place = np.cumsum([0, *(len(p) + 1 for p in parts)])
    starts, h = _word_hashes(b" ".join(parts).lower())
    at = np.searchsorted(starts, place)

    def grams(k: int) -> np.ndarray:
        if len(h) < k:
            return np.zeros(0, np.uint64)
        out = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            out = (out + h[i : len(h) - k + 1 + i]) * _MIX[0]
            out ^= out >> np.uint64(31)
        return _stir(out)

    full, out = grams(n), []
    for i, j in zip(at.tolist(), at[1:].tolist(), strict=False):
        if j - i >= n:
            g = np.sort(full[i : j - n + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif j > i:  # the whole sequence is the one n-gram
            one = np.full(1, np.uint64(j - i))
            for w in h[i:j]:
                one = (one + w) * _MIX[0]
                one ^= one >> np.uint64(31)
            out.append(_stir(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _groups(texts: list[str | None], n: int):
    """rows_of the texts, some at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= AT_ONCE:
            yield from rows_of(held, n)
            held, size = [], 0
    if held:
        yield from rows_of(held, n)


def profile(row: np.ndarray) -> bytes:
    """Cells by group of columns, 255 at most: as many groups, a power of two, as leave each PROFILE cells at most on average."""
    bits = 3
    while len(row) >> bits >= PROFILE and bits < 24:
        bits += 1
    return np.minimum(np.bincount((row >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_shared(profiles: list[bytes], n: np.ndarray, i: int, stop: int, coarse: dict) -> np.ndarray:
    """Bounds of the overlap of row i with the rows from i + 1 to stop, all in the order of size; coarse keeps the profiles by width."""
    width = len(profiles[i])
    if width not in coarse:
        first = next(k for k, x in enumerate(profiles) if len(x) >= width)
        rows = [np.frombuffer(x, np.uint8).reshape(width, -1) for x in profiles[first:]]
        full = np.array([bool((x == 255).any()) for x in rows])
        coarse[width] = first, np.stack([np.minimum(x.sum(1, dtype=np.uint32), 65535).astype(np.uint16) for x in rows]), full
    first, x, full = coarse[width]
    j = slice(i + 1 - first, stop - first)
    return np.where(full[j] | full[i - first], n[i], np.minimum(x[i - first], x[j]).sum(1, dtype=np.int64))


def _row_id(row: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(row.tobytes())


def prefix_size(n: int, percent: int) -> int:
    """Columns of a row of n that suffice: a partner shares at least ceil(t * n) columns."""
    return n - -(-percent * n // 100) + 1


def _slot(cells: np.ndarray) -> np.ndarray:
    return (cells >> np.uint64(20)).astype(np.int64) & (SKETCH - 1)


def _survey(docs: DataFrame, n: int, keys: list) -> DataFrame:
    """keys, r (row), n_shingles and the row's profile (once a task at least) of each document, and blocks of the sketch: kind 1 with the
    block's number in n_shingles."""
    cols = docs.select(docs["text"], *keys)
    names = ["kind", *cols.columns[1:], "r", "n_shingles", "block"]

    def run(batches):
        sketch, seen, types = np.zeros(SKETCH, np.uint32), set(), None

        def count(held):
            slots = _slot(np.concatenate(held)) if held else ()
            for low in range(0, SKETCH if held else 0, SKETCH // 4):  # a quarter at a time keeps the memory small
                part = slots[(slots >= low) & (slots < low + SKETCH // 4)]
                sketch[low : low + SKETCH // 4] += np.bincount(part - low, minlength=SKETCH // 4).astype(np.uint32)

        for b in batches:
            ids, sizes, blocks, held, gathered = [], [], [], [], 0
            types = [c.type for c in b.columns[1:]]
            for row in _groups(b.column(0).to_pylist(), n):
                r = _row_id(row) if len(row) else None
                ids.append(r)
                sizes.append(len(row))
                blocks.append(profile(row) if len(row) and r not in seen else None)
                if r is not None and r not in seen:
                    seen.add(r)
                    held.append(row)
                    gathered += len(row)
                    if gathered >= GATHERED:
                        count(held)
                        held, gathered = [], 0
            if len(seen) > 500_000:
                seen.clear()
            count(held)
            cols = [pa.array([0] * len(ids), pa.int32()), *b.columns[1:], pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)
        for i in range(0, SKETCH if types else 0, SKETCH_BLOCK):
            part = sketch[i : i + SKETCH_BLOCK]
            if part.any():
                raw = part.astype(np.uint8 if part.max() < 256 else "<u4").tobytes()
                cols = [pa.array([1], pa.int32()), *[pa.nulls(1, t) for t in types], pa.nulls(1, pa.binary()), pa.array([i // SKETCH_BLOCK], pa.int64()), pa.array([raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = ", ".join(["kind int", *[f"{c} {t}" for c, t in cols.dtypes[1:]], "r binary, n_shingles long, block binary"])
    return cols.mapInArrow(releasing(run), schema)


def _order(survey: DataFrame) -> np.ndarray:
    """The sketch's counters over their median, the load that all columns give them, on a scale of logarithms: a byte each, an excess
    e is 2 ** (v / 6) at most."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint8 if len(raw) == SKETCH_BLOCK else "<u4")
                total[i] = total.get(i, 0) + part.astype(np.uint64)
        raw = [np.minimum(v, 0xFFFFFFFF).astype("<u4").tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(raw, pa.binary())], ["i", "block"])

    counters = np.zeros(SKETCH, np.uint32)
    blocks = survey.filter("kind = 1").select(F.col("n_shingles").alias("i"), "block")
    for x in blocks.repartition("i").mapInArrow(add, "i long, block binary").collect():  # 4 SKETCH bytes, whatever the input
        counters[x["i"] * SKETCH_BLOCK : (x["i"] + 1) * SKETCH_BLOCK] = np.frombuffer(x["block"], "<u4")
    counters -= np.minimum(counters, np.uint32(np.median(counters)))
    return np.where(counters > 0, np.minimum(1 + np.floor(6 * np.log2(np.maximum(counters, 1), dtype=np.float32)), 255), 0).astype(np.uint8)


def _salts(counter: np.ndarray) -> np.ndarray:
    """Parts of a column whose rows are looked at together."""
    return np.ceil(np.exp2(counter / 6) / HOT).astype(np.int64)


def _prefixes(docs: DataFrame, shared, n: int, percent: int) -> DataFrame:
    """col, salt, key, r, size: the prefix columns of each row, once a task at least. key orders rows by size, then hash; salt is not
    null where the column may have more than HOT rows."""

    def run(batches):
        order, seen = shared.value, set()
        for b in batches:
            cols, salts, keys, ids, sizes = [], [], [], [], []
            for row in _groups(b.column(0).to_pylist(), n):
                if len(row) and 100 * len(row) >= percent * (len(row) + 1):  # else no other set is near enough
                    r = _row_id(row)
                    if r in seen:
                        continue
                    seen.add(r)
                    p = prefix_size(len(row), percent)
                    counter = order[_slot(row)]
                    first = np.argsort(counter, kind="stable")[:p]  # equal counters in the order of their hashes
                    tail = int.from_bytes(r[:5], "big")
                    cols.append(row[first])
                    parts = _salts(counter[first])
                    salts.append(np.where(parts > 1, tail % parts, -1))
                    keys.append(np.full(p, min(len(row), (1 << 23) - 1) << 40 | tail))
                    ids += [r] * p
                    sizes.append(np.full(p, len(row), np.int32))
            if len(seen) > 500_000:
                seen.clear()
            if cols:
                salt = np.concatenate(salts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols).view(np.int64)), pa.array(salt, pa.int64(), mask=salt < 0), pa.array(np.concatenate(keys)), pa.array(ids, pa.binary()), pa.array(np.concatenate(sizes))], ["col", "salt", "key", "r", "size"])

    return docs.select(docs["text"]).mapInArrow(releasing(run), "col long, salt long, key long, r binary, size int")


def _families(docs: DataFrame, order: np.ndarray, n: int, percent: int) -> DataFrame:
    """g, r, size: the rows of each block of the product; rows of a column are in one block. g is the least key of the block's columns."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # SKETCH bytes, whatever the input
    every = Window.partitionBy("col", "salt")  # HOT rows and their repetitions in other tasks, or a part of a column by hash
    cells = _prefixes(docs, shared, n, percent).repartition("col", "salt")
    cells = cells.withColumns({"g": F.min("key").over(every), "lo": F.min("r").over(every), "hi": F.max("r").over(every)})
    of_hot = [F.when(F.col("salt").isNotNull(), F.col(c)).alias(c) for c in ("col", "lo", "hi")]
    cells = park(cells.filter("salt IS NOT NULL OR lo <> hi").select("salt", "g", "r", "size", *of_hot))
    out = cells.filter("salt IS NULL").select("g", "r", "size")
    if _salts(order.max(initial=0)) > 1:
        hot = cells.filter("salt IS NOT NULL")
        of = hot.groupBy("col").agg(F.min("g").alias("g"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("col", "g")
        out = out.unionByName(hot.select("col", "r", "size").join(broadcast_if_small(of, MAX_SMALL), "col").select("g", "r", "size"))
    out = park(out.groupBy("g", "r").agg(F.first("size").alias("size")))
    discard(cells)
    shared.destroy()
    return out


def _key() -> Column:
    """What orders rows by size, then hash."""
    tail = F.conv(F.substring(F.hex("r"), 1, 10), 16, 10).cast("long")
    return F.shiftleft(F.least(F.col("size"), F.lit((1 << 23) - 1)).cast("long"), 40).bitwiseOR(tail)


def _large(families: DataFrame) -> DataFrame | None:
    """The families (g) that are cut; null if there is none."""
    large = park(families.groupBy("g").agg(F.sum(F.col("size").cast("long") + ROW).alias("w")).filter(F.col("w") > BLOCK).select("g"))
    return None if large.isEmpty() else broadcast_if_small(large, MAX_SMALL)


def _sized(members: DataFrame, percent: int, *extra: Column) -> DataFrame:
    """Members of families that aren't cut, without those whose neighbours by size in their family are both too far away."""
    order = Window.partitionBy("g").orderBy("size")
    near = lambda less, more: less * 100 >= more * percent
    there = members.withColumns({"_prev": F.lag("size").over(order), "_next": F.lead("size").over(order)})
    keep = F.coalesce(near(F.col("_prev"), F.col("size")), F.lit(False)) | F.coalesce(near(F.col("size"), F.col("_next")), F.lit(False))
    for x in extra:
        keep = keep & x
    return there.filter(keep).drop("_prev", "_next")


def _parts(rows: DataFrame, percent: int, *of: str) -> tuple[DataFrame, DataFrame]:
    """Members of cut families with their size class k and part; the parts (g, of, k, parts). Rows that differ in a column of of share no part."""
    weight = F.col("size").cast("long") + ROW
    k = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / percent) + 1e-9)).cast("int")  # sizes near enough are a class apart at most
    rows = rows.withColumn("k", k)
    parts = park(rows.groupBy("g", *of, "k").agg(F.ceil(F.sum(weight) / F.lit(BLOCK / 2)).cast("int").alias("parts")))
    own = rows.join(broadcast_if_small(parts, MAX_SMALL), ["g", *of, "k"]).withColumn("part", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int")).drop("parts")
    return own, parts


def _alone(own: DataFrame, parts: DataFrame, *extra: str) -> DataFrame:
    """block, r, extra: each part by itself, with the smallest row of its family in every part whose sizes allow it."""
    lead = own.filter(F.col("g") == _key()).select("g", "r", *extra, F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"))
    lead = lead.join(parts, ["g", "k"]).select("g", "r", *extra, "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    named = lambda df: df.select(F.xxhash64("g", "k", "part").alias("block"), "r", *extra)
    return named(own).unionByName(named(lead)).distinct()


def _first(families: DataFrame, large: DataFrame | None, percent: int) -> DataFrame:
    """block, r of the first round."""
    best = families.groupBy("r").agg(F.min("g").alias("_least"))
    members = families.join(best, "r").filter((F.col("g") == F.col("_least")) | (F.col("g") == _key())).select("g", "r", "size")
    if large is None:
        return _sized(members, percent).select(F.xxhash64("g").alias("block"), "r")
    members = park(members)
    own, parts = _parts(members.join(large, "g", "left_semi"), percent)
    whole = _sized(members.join(large, "g", "left_anti"), percent).select(F.xxhash64("g").alias("block"), "r")
    return whole.unionByName(_alone(own, parts))


def _labelled(families: DataFrame, comps: DataFrame) -> DataFrame:
    return families.join(comps, "r", "left").select("g", "r", "size", F.coalesce("c", "r").alias("label"))


def _mixed(cut: DataFrame) -> DataFrame:
    """Members of the families with several components."""
    mixed = park(cut.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("g"))
    return cut.join(broadcast_if_small(mixed, MAX_SMALL), "g", "left_semi")


def _between(families: DataFrame, large: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """block, r, label, side of the round between: the parts of cut families alone, with all their rows. It joins nearly all near copies, which
    would otherwise meet and be linked again in each two parts of each of their families."""
    cut = park(_labelled(families.join(large, "g", "left_semi"), comps))
    own, parts = _parts(_mixed(cut), percent)
    return _alone(own, parts, "label").withColumn("side", F.xxhash64("r"))


def _second(families: DataFrame, large: DataFrame | None, comps: DataFrame, percent: int) -> DataFrame:
    """block, r, label, side of the second round: the blocks with several components, cut ones as every two parts whose sizes allow it; of two
    parts, rows of one side have met in their own part."""
    label = _labelled(families, comps)
    every, alone = Window.partitionBy("g"), F.xxhash64("r")
    kinds = lambda df: df.withColumns({"_lo": F.min("label").over(every), "_hi": F.max("label").over(every)})
    block = lambda df: _sized(kinds(df), percent, F.col("_lo") != F.col("_hi")).select(F.xxhash64("g").alias("block"), "r", "label", alone.alias("side"))
    if large is None:
        return block(label)
    label = park(label)
    cut = park(_mixed(label.join(large, "g", "left_semi")))
    # a component that is large itself has its own parts, which don't meet each other
    mass = park(cut.groupBy("g", "label").agg(F.sum(F.col("size").cast("long") + ROW).alias("w")).filter(F.col("w") > BLOCK).select("g", "label", F.col("label").alias("of")))
    cut = cut.join(broadcast_if_small(mass, MAX_SMALL), ["g", "label"], "left").withColumn("of", F.coalesce("of", F.lit(b"")))
    own, parts = _parts(cut, percent, "of")
    near = own.withColumn("l", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    other = parts.select("g", F.col("of").alias("to"), F.col("k").alias("l"), "parts")
    met = near.join(broadcast_if_small(other, MAX_SMALL), ["g", "l"]).filter((F.col("of") != F.col("to")) | (F.col("of") == F.lit(b"")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two = F.struct("of", "k", "part"), F.struct(F.col("to").alias("of"), F.col("l").alias("k"), F.col("other").alias("part"))
    side = F.when(one == two, alone).otherwise(F.xxhash64("of", "k", "part"))
    met = met.select(F.xxhash64("g", F.least(one, two), F.greatest(one, two)).alias("block"), "r", "label", side.alias("side"))
    return block(label.join(large, "g", "left_anti")).unionByName(met)


def _by_block(df: DataFrame, task, schema: str) -> DataFrame:
    """task on the rows of each block, a list of columns; a task holds one block at a time."""

    def run(batches):
        key, held = None, []

        def done():
            return task([np.concatenate(c) if isinstance(c[0], np.ndarray) else list(chain.from_iterable(c)) for c in zip(*held, strict=True)]) if held else None

        for b in batches:
            block = b.column(0).to_numpy(zero_copy_only=False)
            cols = [block, *[c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]]
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
            for i, j in zip(edges, edges[1:], strict=False):
                if block[i] != key:
                    if (out := done()) is not None:
                        yield out
                    key, held = block[i], []
                held.append([c[i:j] for c in cols])
        if (out := done()) is not None:
            yield out

    return df.repartition("block").sortWithinPartitions("block").mapInArrow(releasing(run), schema)


def _live(blocks: DataFrame, profiles: DataFrame, percent: int, second: bool) -> DataFrame:
    """Of blocks (block, r; label and side in the second round) the rows that may be at the threshold with another by their sizes and profiles."""

    def task(cols):
        block, r, n = cols[:3]
        if len(r) < 2:
            return None
        order = np.argsort(n, kind="stable")
        profiles, n, live, coarse = [cols[3][i] for i in order], n[order], np.zeros(len(r), bool), {}
        apart = [np.array(c, object)[order] if isinstance(c, list) else c[order] for c in cols[4:]]
        ends = np.searchsorted(n, n * 100 // percent, "right")  # sizes that are near enough
        for i in range(len(r) - 1):
            stop = int(ends[i])
            if stop <= i + 1:
                continue
            j = slice(i + 1, stop)
            near = np.ones(stop - i - 1, bool)
            for c in apart:
                near &= (c[j] != c[i]).astype(bool)
            if not near.any():
                continue
            most = most_shared(profiles, n, i, stop, coarse)
            near &= 100 * most >= percent * (n[i] + n[j] - most)
            if near.any():
                live[i] = True
                live[j] |= near
        keep = order[live]
        if not len(keep):
            return None
        out = [pa.array(block[keep]), pa.array([r[i] for i in keep], pa.binary())]
        names = ["block", "r"]
        if second:
            out += [pa.array([cols[4][i] for i in keep], pa.binary()), pa.array(cols[5][keep])]
            names += ["label", "side"]
        return pa.RecordBatch.from_arrays(out, names)

    extra = ["label", "side"] if second else []
    full = blocks.join(profiles, "r").select("block", "r", "n_shingles", F.col("profile"), *extra)
    return _by_block(full, task, "block long, r binary" + (", label binary, side long" if second else ""))


def _rows(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """r and cells (sorted hashes) of the rows in wanted (r, doc_id): their texts are read once more."""
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    found = found.join(broadcast_if_small(wanted.select(F.col("doc_id").alias("id")).distinct(), MAX_SMALL), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(batches):
        for b in batches:
            rows = [x for x in _groups(b.column(1).to_pylist(), n) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([_row_id(x) for x in rows], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in rows], pa.binary())], ["r", "cells"])

    return found.mapInArrow(releasing(run), "r binary, cells binary").join(wanted.select("r"), "r", "left_semi").dropDuplicates(["r"])


def _columns(cells: list[np.ndarray]) -> list[np.ndarray]:
    """Of a block's rows the columns that two hold at least: for each number of holders, from few to many, the holders of each column. There may be
    none: rows that met through a third one need not share a column, and the third one may be gone."""
    who = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    every = np.concatenate(cells)
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    edge = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    held = np.diff(np.append(edge, len(every)))
    edge, held = edge[held > 1], held[held > 1]
    if not len(held):
        return []
    order = np.argsort(held, kind="stable")
    edge, held = edge[order], held[order]
    cuts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    return [who[edge[i:j, None] + np.arange(held[i])] for i, j in zip(cuts, [*cuts[1:], len(held)], strict=True)]


def linked(cells: list[np.ndarray], percent: int, apart: tuple = ()) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows at the threshold: the product of a block with its transpose. Rows that agree in any
    of apart don't count as a pair."""
    m = len(cells)
    n = np.array([len(c) for c in cells], np.int32 if max(map(len, cells), default=0) < 5_000_000 else np.int64)
    if m < 2:
        return []
    need = -(-percent * (n[:, None] + n[None, :]) // (100 + percent))  # the least overlap of two sizes
    alive = np.triu(need <= np.minimum(n[:, None], n[None, :]), 1)
    for c in apart:
        alive &= (c[:, None] != c[None, :]).astype(bool)
    if not alive.any():
        return []
    columns = _columns(cells)
    overlap = np.zeros(m * m, np.int32)
    light = max(16, m // 10)
    for holders in columns:  # columns of few rows: each of their pairs is counted
        width = holders.shape[1]
        if width > light:
            break
        a, b = np.triu_indices(width, 1)
        step = max(1, PAIRS // len(a))
        for i in range(0, len(holders), step):
            part = holders[i : i + step]
            pairs = (part[:, a] * m + part[:, b]).ravel()
            if len(pairs) * 8 < m * m:
                np.add.at(overlap, pairs, 1)
            else:
                overlap += np.bincount(pairs, minlength=m * m).astype(np.int32)
    overlap = overlap.reshape(m, m)
    heavy = [h for h in columns if h.shape[1] > light]
    if heavy:
        rest = sum(np.bincount(h.ravel(), minlength=m) for h in heavy).astype(np.int32)

        def discard_pairs():
            np.logical_and(alive, overlap + np.minimum(rest[:, None], rest[None, :]) >= need, out=alive)

        discard_pairs()
        for holders in heavy:  # common columns: dense slabs of the rows that still have a pair
            for i in range(0, len(holders), SLAB):
                keep = np.flatnonzero(alive.any(0) | alive.any(1))
                if not len(keep):
                    return []
                part = holders[i : i + SLAB]
                slab = np.zeros((m, len(part)), np.float32)
                slab[part, np.arange(len(part))[:, None]] = 1
                if len(keep) < m:
                    slab = slab[keep]
                    overlap[np.ix_(keep, keep)] += (slab @ slab.T).astype(np.int32)
                else:
                    overlap += (slab @ slab.T).astype(np.int32)
                rest -= np.bincount(part.ravel(), minlength=m).astype(np.int32)
                discard_pairs()
    near = alive & (overlap >= need)
    near |= near.T
    edges, left = [], np.ones(m, bool)
    for i in np.flatnonzero(near.any(0)).tolist():
        if left[i]:
            left[i], open_ = False, [i]
            while open_:
                new = np.flatnonzero(near[open_].any(0) & left)
                left[new] = False
                edges += [(i, j) for j in new.tolist()]
                open_ = new.tolist()
    return edges


def _links(live: DataFrame, rows: DataFrame, percent: int, second: bool) -> DataFrame:
    """a, b: in each block, edges that join its rows at the threshold."""

    def task(cols):
        r = cols[1]
        found = linked([np.frombuffer(c, "<u8") for c in cols[2]], percent, tuple(np.array(c, object) if isinstance(c, list) else c for c in cols[3:]))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array([r[e[i]] for e in found], pa.binary()) for i in (0, 1)], ["a", "b"])

    extra = ["label", "side"] if second else []
    return _by_block(rows.join(live, "r").select("block", "r", "cells", *extra), task, "a binary, b binary")


def _joined(edges: DataFrame) -> DataFrame:
    """components of EDGES edges (u, v) at most, by one task that joins them in a table of parents."""
    kind = pa.binary() if edges.schema["u"].dataType.typeName() == "binary" else pa.int64()
    name = edges.schema["u"].dataType.simpleString()

    def run(batches):
        up: dict = {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = top(u), top(v)
                if a != c:
                    up[max(a, c)] = min(a, c)
        ends = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(ends, kind), pa.array([top(x) for x in ends], kind)], ["r", "c"])

    return edges.select("u", "v").repartition(1).mapInArrow(releasing(run), f"r {name}, c {name}")


def components(links: DataFrame) -> DataFrame:
    """r, c for all ends of links (a, b): c is the smallest of r's component. Up to EDGES links, one task does it; more take
    alternating large and small stars, each a join on keys with its lineage cut."""
    edges = park(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if edges.limit(EDGES + 1).count() <= EDGES:
        return _joined(edges)
    last = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        big = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = park(small.filter("u <> v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = new
        if last == now:
            break
        last = now
    ends = edges.select(F.col("u").alias("r"), F.col("v").alias("c"))
    return ends.unionByName(edges.select(F.col("v").alias("r"), F.col("v").alias("c")).distinct())


def join(docs: DataFrame, n: int, percent: int, keys: bool = False) -> DataFrame:
    """One row a document: doc_id, r (equal sets have equal r; null without words), n_shingles, c (equal in a component; null without
    words) and component_id, the smallest doc_id that links of a Jaccard index of percent / 100 or more lead to. With keys, t1 and t2, two
    hashes of the text, as well."""
    ship(docs.sparkSession)
    of = [docs["doc_id"].cast("long").alias("doc_id")]
    if keys:
        of += [F.xxhash64(docs["text"]).alias("t1"), F.xxhash64(F.lit(1), docs["text"]).alias("t2")]
    survey = park(_survey(docs, n, of))
    members = survey.filter("kind = 0").select("doc_id", *(["t1", "t2"] if keys else []), "r", "n_shingles")
    reps = members.filter("r IS NOT NULL").groupBy("r").agg(F.min("doc_id").alias("doc_id"))
    profiles = survey.filter("kind = 0 AND block IS NOT NULL").select("r", "n_shingles", F.col("block").alias("profile")).dropDuplicates(["r"])

    families = _families(docs, _order(survey), n, percent)
    large = _large(families)
    parked = [survey, families]

    def links(blocks: DataFrame, second: bool) -> DataFrame:
        live = park(_live(blocks, profiles, percent, second))
        wanted = park(live.select("r").distinct().join(reps, "r"))
        found = park(_links(live, _rows(docs, wanted, n), percent, second))
        discard(live, wanted)
        parked.append(found)
        return found

    found = links(_first(families, large, percent), False)
    comps = park(components(found))
    parked.append(comps)
    if large is not None:
        found = found.unionByName(links(_between(families, large, comps, percent), True))
        comps = park(components(found))
        parked.append(comps)
    more = links(_second(families, large, comps, percent), True)
    if not more.isEmpty():
        comps = park(components(found.unionByName(more)))
        parked.append(comps)
    groups = comps.join(reps, "r").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = reps.join(comps, "r", "left").join(groups, "c", "left").select("r", F.coalesce("c", "r").alias("c"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = park(members.join(named, "r", "left").select(*members.columns, "c", F.coalesce("component_id", "doc_id").alias("component_id")))
    discard(*parked)
    return out


def op7(docs: DataFrame) -> DataFrame:
    return join(docs, 3, 90).select("doc_id", "n_shingles", "component_id")


def one_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, the columns as they are, whatever their names. A row goes by its doc_id and text: the first by
    doc_id, then by the text's hash, stays; of rows equal in both, any one. Rows without words or doc_id all stay. Rows that share a
    doc_id but not the text are told apart."""
    found = join(docs, n, percent, keys=True).filter("c IS NOT NULL AND doc_id IS NOT NULL")
    key = F.struct("doc_id", "t1", "t2")
    several = park(found.groupBy("c").agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1").select("c", "first"))
    judged = found.join(broadcast_if_small(several, MAX_SMALL), "c").groupBy("doc_id", "t1", "t2").agg(F.first(key == F.col("first")).alias("stays"), F.count("*").alias("n"))
    judged = park(judged.filter("n > 1 OR NOT stays").select(F.col("doc_id").alias("_d"), F.col("t1").alias("_1"), F.col("t2").alias("_2"), "stays"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("d"), F.xxhash64(docs["text"]).alias("h1"), F.xxhash64(F.lit(1), docs["text"]).alias("h2"))
    same = F.col("d").eqNullSafe(F.col("_d")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2"))
    out = rows.join(broadcast_if_small(judged.drop("stays"), MAX_SMALL), same, "left_anti").select("row.*")
    again = judged.filter("stays")
    if again.isEmpty():
        return out
    return out.unionByName(rows.join(broadcast_if_small(again, MAX_SMALL), same, "left_semi").dropDuplicates(["d", "h1", "h2"]).select("row.*"))

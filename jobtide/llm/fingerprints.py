"""Document fingerprints by order MinHash, in DataFrame operations only.

The symbols are words; a k-mer is K words in a row (a text with fewer has one k-mer, all its words). A k-mer's occurrences in a text
are numbered, each numbered occurrence has a hash, and the hash's top bits choose one of BINS bins: one permutation, cut in
BINS parts, instead of as many permutations. Of each bin the two smallest are taken in the order in which they stand in the text,
and the hash of that tuple is the bin's part of the fingerprint; a bin with one takes the smallest of the next filled bin as its second,
the last filled bin that of the first, so that short texts carry order, too. A changed passage changes the bins whose smallest
occurrences it holds, a moved one those whose order it turns round. Likeness is the share of equal bins among those that
either text fills; it falls with the edit distance.

Occurrences are numbered without a shuffle: k-mers and their places are packed in longs and sorted within the text, and the
number of an occurrence is found by galloping back over equal ones. A place has 28 bits, so a text may have 268 million words (2 GB of
longs, which a task must hold in any case); words beyond that would share places with the first ones.

Defined results: a null text counts as empty; a text without words has an empty fingerprint of BINS blanks, which is like another
such one (1) and unlike all others (0); repeated rows and ties in doc_id are ordered by the text's hash; an empty table gives an empty
table; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import MAX_SMALL, broadcast_if_small, park

K, BINS, PLACE_BITS, BLANK = 5, 64, 28, 0
#: Documents that one window orders, and bounds of the ranges that a plan holds at most; there, a range is cut in pieces of equal width.
RANGE, MOST = 4096, 32_768


def _hold(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that the optimizer computes once: it doesn't merge projections through a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out, the parts of the fingerprint of the column text: BINS numbers, BLANK for an empty bin."""
    keep, place = df.columns, (1 << PLACE_BITS) - 1
    df = _hold(df, "_w", F.transform(F.split(F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\f\r", " " * 5)), " +"), lambda w: F.xxhash64(w)))
    words = "_w"
    kmers = f"""CASE WHEN size({words}) = 1 AND {words}[0] = xxhash64('') THEN cast(array() AS array<bigint>)
        WHEN size({words}) < {K} THEN array(shiftleft(xxhash64({words}), {PLACE_BITS}))
        ELSE sort_array(transform(sequence(0, size({words}) - {K}), i ->
            shiftleft(shiftrightunsigned(xxhash64({", ".join(f"{words}[i + {j}]" for j in range(K))}), {PLACE_BITS}), {PLACE_BITS}) | i)) END"""
    df = _hold(df, "_s", F.expr(kmers))

    numbered = f"""transform(_s, (x, i) -> CASE WHEN i = 0 OR shiftright(_s[i - 1], {PLACE_BITS}) <> shiftright(x, {PLACE_BITS}) THEN
        {_packed("x", "0", place)} ELSE {_packed("x", _back(), place)} END)"""
    df = _hold(df, "_r", F.expr(f"sort_array({numbered})"))
    bits = BINS.bit_length() - 1
    starts = f"filter(transform(_r, (x, i) -> CASE WHEN i = 0 OR shiftrightunsigned(_r[i - 1], {64 - bits}) <> shiftrightunsigned(x, {64 - bits}) THEN i ELSE -1 END), i -> i >= 0)"
    value = lambda x: f"shiftrightunsigned({x}, {PLACE_BITS})"
    after = "_r[(i + 1) % size(_r)]"  # of a bin with one occurrence, the smallest of the next filled bin
    part = f"""CASE WHEN size(_r) = 1 THEN xxhash64({value("_r[i]")})
        WHEN ({after} & {place}) > (_r[i] & {place}) THEN xxhash64({value("_r[i]")}, {value(after)}) ELSE xxhash64({value(after)}, {value("_r[i]")}) END"""
    found = f"map_from_entries(transform({starts}, i -> struct(cast(shiftrightunsigned(_r[i], {64 - bits}) AS int), cast(shiftright({part}, 32) AS int) | 1)))"
    df = _hold(df, "_m", F.expr(found))
    parts = F.expr(f"transform(sequence(0, {BINS - 1}), b -> coalesce(try_element_at(_m, b), {BLANK}))")
    return _hold(df, out, parts).select(*keep, out)


def _packed(x: str, number: str, place: int) -> str:
    return f"(shiftleft(shiftrightunsigned(xxhash64(shiftrightunsigned({x}, {PLACE_BITS}), {number}), {PLACE_BITS}), {PLACE_BITS}) | ({x} & {place}L))"


def _back() -> str:
    """How many elements before i in _s are of x's k-mer: they stand together, so steps of halved length find their first place."""
    same = f"shiftright(_s[i - a - h], {PLACE_BITS}) = shiftright(x, {PLACE_BITS})"
    steps = "transform(sequence(0, 27), j -> cast(shiftleft(1, 27 - j) AS int))"
    return f"aggregate({steps}, 0, (a, h) -> CASE WHEN i - a - h >= 0 AND {same} THEN a + h ELSE a END)"


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of parts: equal bins by bins that either fills; 1 if neither fills any."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    filled = F.size(F.filter(both, lambda z: (z["a"] != BLANK) | (z["b"] != BLANK)))
    equal = F.size(F.filter(both, lambda z: (z["a"] != BLANK) & (z["a"] == z["b"])))
    return F.when(filled == 0, F.lit(1.0)).otherwise(equal / filled)


def text_of(parts: Column) -> Column:
    """The fingerprint as text: 8 hexadecimal digits a bin, or blanks."""
    digits = lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.array_join(F.transform(parts, lambda x: F.when(x == BLANK, "-" * 8).otherwise(digits(x))), "")


class Ranges:
    """Ranges of about RANGE rows in the order of descending _id, nulls last: parts of equal numbers of rows between bounds (MOST of them at most,
    a literal array that is searched by halving), each cut in subs pieces of equal width; rows without an id in pieces by their text's hash."""

    def __init__(self, bounds: list[int], low: int, high: int, subs: int):
        self.bounds, self.low, self.high, self.subs = bounds, low, high, subs

    @classmethod
    def of(cls, df: DataFrame, rows: int = RANGE, most: int = MOST) -> Ranges:
        n, low, high = df.agg(F.count("_id"), F.min("_id"), F.max("_id")).first()
        parts = min(max(n // rows, 1), most)
        found = [] if parts == 1 else df.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0]
        return cls(sorted(set(found or [])), low or 0, high or 0, max(1, -(-n // (rows * parts))) if n > rows else 1)

    def columns(self) -> tuple[Column, Column]:
        """The part and the piece of a row, both ascending in the order."""
        edges = [self.low, *self.bounds, self.high + 1 if self.high < (1 << 63) - 1 else self.high]
        array = f"cast(split('{','.join(map(str, edges))}', ',') AS array<bigint>)"
        steps = f"array({', '.join(str(1 << i) for i in reversed(range(max(len(edges) - 1, 1).bit_length())))})"
        last = len(edges) - 1
        at = F.expr(f"aggregate({steps}, 0, (a, s) -> CASE WHEN a + s < {last} AND {array}[a + s] <= _id THEN a + s ELSE a END)")
        null = F.col("_id").isNull()
        if self.subs == 1:
            return F.when(null, F.lit(1)).otherwise(-at), F.when(null, F.shiftright(F.xxhash64("_t"), 56).cast("int")).otherwise(F.lit(0))
        part = F.when(~null, at)
        lo, hi = F.expr(f"{array}[{{0}}]".replace("{0}", "_part")), F.expr(f"{array}[{{0}}]".replace("{0}", "_part + 1"))
        wide = hi.cast("double") - lo.cast("double")
        piece = F.least(F.floor((F.col("_id").cast("double") - lo.cast("double")) / F.greatest(wide, F.lit(1.0)) * self.subs), F.lit(self.subs - 1)).cast("int")
        return part, piece


def with_guests(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """rows (_id, _t) with _range, _piece and _guest: the first row of each piece is a guest in the piece before it, after all of that
    one's own rows, and the first row of all in the last piece. So the next row of any row is in its own piece."""
    part, piece = ranges.columns()
    null = F.col("_id").isNull()
    if ranges.subs == 1:
        rows = rows.withColumn("_range", part).withColumn("_piece", piece)
    else:
        rows = rows.withColumn("_part", part).withColumn("_piece", F.when(null, F.shiftright(F.xxhash64("_t"), 56).cast("int")).otherwise(-piece))
        rows = rows.withColumn("_range", F.when(null, F.lit(1)).otherwise(-F.col("_part"))).drop("_part")
    rows = rows.withColumn("_guest", F.lit(False)).select("_id", "_t", "_range", "_piece", "_guest")
    first = park(rows.groupBy("_range", "_piece").agg(F.min(F.struct(F.bitwise_not("_id").alias("d"), F.xxhash64("_t").alias("h"))).alias("f")))
    ring, all_ = Window.orderBy("_range"), Window.partitionBy(F.lit(0))
    parts = first.groupBy("_range").agg(F.max("_piece").alias("_end"))  # a row a part, MOST + 1 at most
    parts = parts.withColumn("_before", F.lag(F.struct("_range", "_end")).over(ring)).withColumn("_final", F.max(F.struct("_range", "_end")).over(all_))
    inner = F.lag("_piece").over(Window.partitionBy("_range").orderBy("_piece"))
    hosts = first.withColumn("_last", inner).join(F.broadcast(parts), "_range")
    other = F.coalesce("_before", "_final")
    host = F.when(F.col("_last").isNotNull(), F.struct(F.col("_range"), F.col("_last").alias("_end"))).otherwise(other)
    hosts = park(hosts.select(host.alias("_host"), F.bitwise_not("f.d").alias("d"), F.col("f.h").alias("h")))
    guests = rows.join(broadcast_if_small(hosts, MAX_SMALL), F.col("_id").eqNullSafe(F.col("d")) & (F.xxhash64("_t") == F.col("h"))).dropDuplicates(["_host"])
    out = rows.unionByName(guests.select("_id", "_t", F.col("_host._range").alias("_range"), F.col("_host._end").alias("_piece"), F.lit(True).alias("_guest")))
    return out


def op8(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), F.coalesce(docs["text"], F.lit("")).alias("_t"))
    rows = fingerprint(with_guests(rows, Ranges.of(rows.select("_id"))), "_t", "_fp")
    window = Window.partitionBy("_range", "_piece").orderBy("_guest", F.col("_id").desc_nulls_last(), F.xxhash64("_t"), "_t")
    rows = rows.withColumn("next__t", F.lead("_t").over(window)).withColumn("next__fp", F.lead("_fp").over(window)).filter("NOT _guest")
    n = F.length("_t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_t"), F.lit(1), n - third), F.substring(F.col("next__t"), F.lit(1), third))
    rows = _hold(rows, "_e", edited)
    rows = fingerprint(rows, "_e", "_efp")
    return rows.select(
        F.col("_id").alias("doc_id"), F.length("_t").cast("long").alias("n_chars"), F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("_fp")).alias("fingerprint"), text_of(F.col("_efp")).alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"), likeness(F.col("_fp"), F.col("next__fp")).alias("near_next"),
    )

"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same wanted number of copies, target / source size. Its whole part is taken as it is; the
fraction is a copy probability, and probability times size is the mass in words. Two documents at a time meet: a random
transfer, fair in expectation, moves mass from one to the other until one of them has none or all of its size. The other one
stays open and meets the next. Chunks of about FAN documents are folded on their own; the open document of each goes to the
next level of a reduction tree, until one a source is left, which is rounded at random. The sum of the masses never changes
before that, so what a source gives is off its target by one document at most.

All of it is DataFrame operations. Rows equal in doc_id, text and source are counted first: n of them with the fraction f are n f copies, of
which the whole part is taken and the rest is one unit, so that no fold ever gathers them; they share their copies as evenly as can be.

Defined results: null or empty texts have size 0 and taken 0; a null source is a source, the last; repeated rows are documents of their
own; sizes that tie go by hash; a text of any length is one unit, and may be off its source's target by its size; an empty table gives an
empty table; extra columns are not looked at, and stay in mixed, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, broadcast_if_small, discard, park

#: Documents folded together, and the largest table of sources that is broadcast.
FAN, MAX_BROADCAST_SOURCES = 64, 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """A weight for each source: weights in turn, in the order of code points, null last. One row a source."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(n, F.lit(len(weights))) + 1).cast("int")))


def targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """sources (source, source_size, weight) with target: share of all sizes dealt by weight; none gets over cap times its size, and
    the excess is dealt again. In the order of cap * size / weight the full ones come first; the level of the rest is the largest
    of the levels that each prefix would leave."""
    full = F.col("source_size") * F.lit(cap)
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    level = (F.sum("source_size").over(every) * F.lit(share) - zero(F.sum(full).over(before))) / (F.sum("weight").over(every) - zero(F.sum("weight").over(before)))
    return sources.withColumn("_level", level).withColumn("target", F.least(full, F.max("_level").over(every) * F.col("weight")).cast("double")).drop("_level")


#: small comes first, so that chunks fold from large to small documents and the one left open is a small one.
_UNIT = ("small", "h", "doc_id", "key", "size", "many", "mass")


def _fold(seed: int, level: int) -> Column:
    """Of the array us of units: out, those that are settled (up: one copy more), and o, the open one."""

    def unit(x: str, mass: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', {mass if f == 'mass' else f'{x}.{f}'}" for f in _UNIT) + ")"

    def settled(x: str, up: str) -> str:
        return f"named_struct('doc_id', {x}.doc_id, 'key', {x}.key, 'size', {x}.size, 'many', {x}.many, 'up', {up})"

    def case(x: str, up: str, y: str, mass: str) -> str:
        return f"named_struct('o', {unit(y, mass)}, 'out', concat(a.out, array({settled(x, up)})))"

    gain, loss = "least(a.o.size - a.o.mass, x.mass)", "least(a.o.mass, x.size - x.mass)"
    draw = f"(shiftrightunsigned(xxhash64({seed}L, {level}, a.o.h, x.h), 11) * {2.0**-53!r}D)"
    step = f"""CASE WHEN {draw} * ({gain} + {loss}) < {loss}
        THEN CASE WHEN a.o.size - a.o.mass <= x.mass THEN {case("a.o", "true", "x", "x.mass - (a.o.size - a.o.mass)")} ELSE {case("x", "false", "a.o", "a.o.mass + x.mass")} END
        ELSE CASE WHEN a.o.mass <= x.size - x.mass THEN {case("a.o", "false", "x", "x.mass + a.o.mass")} ELSE {case("x", "true", "a.o", "a.o.mass - (x.size - x.mass)")} END END"""
    none = "cast(array() AS array<struct<doc_id: bigint, key: bigint, size: bigint, many: bigint, up: boolean>>)"
    return F.expr(f"aggregate(slice(us, 2, size(us)), named_struct('o', us[0], 'out', {none}), (a, x) -> {step})")


def copies(docs: DataFrame, seed: int = 20240101, share: float = 1.5, cap: float = 2.0, weigh=cyclic_weights) -> DataFrame:
    """One row a document: doc_id, key (a hash of text and source), source, size, source_size, target, copies.

    docs has doc_id, text and source; other columns are ignored. weigh adds the declared weight to the table of sources, which has
    a row a source and so is as small as the declaration."""
    units = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text", "source").alias("key"),
        "source",
        word_count(F.col("text")).alias("size"),
    )
    units = park(units.groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("many")))
    sources = park(targets(weigh(units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.count("*").alias("n"))), share, cap).withColumn("sid", F.xxhash64("source", F.col("source").isNull())))
    largest = sources.agg(F.max("n")).first()[0] or 0
    names = broadcast_if_small(sources.select("sid", "source", "source_size", "target", "n"), MAX_BROADCAST_SOURCES)

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    spread = units.withColumn("sid", F.xxhash64("source", F.col("source").isNull())).drop("source").join(names.select("sid", "n", rate.alias("rate")), "sid")
    extra = (F.col("rate") - F.floor("rate")) * F.col("many")  # copies beside the whole part of each
    fraction = extra - F.floor(extra)
    fixed = (fraction <= 0) | (F.col("size") == 0)
    whole = spread.filter(fixed).select("sid", "doc_id", "key", "size", "many", F.lit(False).alias("up"))
    open_units = spread.filter(~fixed).select(
        "sid", "n", F.struct((-F.col("size")).alias("small"), F.xxhash64(F.lit(seed), "doc_id", "key").alias("h"), "doc_id", "key", "size", "many", (fraction * F.col("size")).alias("mass")).alias("u")
    )
    done, level, most, parked = [whole], 0, largest, []
    while True:
        parts = F.greatest(F.ceil(F.col("n") / F.lit(float(FAN) ** (level + 1))), F.lit(1)).cast("long")
        chunk = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("u.h")), parts)
        folded = open_units.withColumn("chunk", chunk).groupBy("sid", "n", "chunk").agg(F.sort_array(F.collect_list("u")).alias("us")).select("sid", "n", _fold(seed, level).alias("f"))
        folded = park(folded)
        parked.append(folded)
        done.append(folded.select("sid", F.explode("f.out").alias("s")).select("sid", "s.*"))
        open_units = folded.select("sid", "n", F.col("f.o").alias("u"))
        most = math.ceil(most / FAN)
        level += 1
        if most <= 1:
            break
    u = open_units.select("sid", "u.*")
    done.append(u.select("sid", "doc_id", "key", "size", "many", (unit_draw(seed) * F.col("size") < F.col("mass")).alias("up")))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    every = every.join(names.withColumn("rate", rate), "sid").withColumn("all", (F.floor("rate") * F.col("many") + F.floor(extra) + F.col("up").cast("long")).cast("long"))
    share_of = F.floor(F.col("all") / F.col("many")) + (F.col("i") <= F.pmod(F.col("all"), F.col("many"))).cast("long")
    out = every.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).select("doc_id", "key", "source", "size", "source_size", "target", share_of.cast("long").alias("copies"))
    out = park(out)
    discard(units, sources, *parked)
    return out


def unit_draw(seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("last"), "h"), 11) * F.lit(2.0**-53)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it; the columns stay as they are.

    Rows that are equal in doc_id, text and source share their copies: the first of them get one more. The join is on the
    documents' keys, and the window that numbers equal rows needs no shuffle of its own."""
    picks = copies(docs, **options).groupBy("doc_id", "key").agg(F.sum("copies").alias("all"), F.count("*").alias("n"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"], docs["source"]).alias("k"))
    joined = rows.join(picks, (rows["k"] == picks["key"]) & rows["id"].eqNullSafe(picks["doc_id"]))
    joined = joined.withColumn("i", F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("k")))
    times = F.floor(F.col("all") / F.col("n")) + (F.col("i") <= F.pmod(F.col("all"), F.col("n"))).cast("long")
    out = joined.withColumn("times", times.cast("int")).filter("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op1(docs: DataFrame) -> DataFrame:
    c = copies(docs)
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")

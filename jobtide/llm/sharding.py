"""Sharding by a k-d tree over document metadata.

The units are groups of equal texts, which stay together, with their bytes as weight. A node that owes k shards is cut in two at a
weighted quantile (the median when k is even) along the dimension in which its units lie widest; a leaf owes one shard. The
dimensions are the size (as a logarithm), the source, the language and the smallest doc_id of the group, each on a grid of 2**20
cells; ties in a cell are ordered by a hash of the text, so any cell can be cut. A quantile is found by histograms, summed up
for all nodes of a level at once and refined within the cell that holds it until that weighs next to nothing. A pass over the units is one
grouped sum; its histograms, of BINS cells over all nodes (at least LEAST a node), come to the driver, which keeps a few numbers a
node: what it holds is bounded by BINS and the number of shards, not by the rows.

Defined results: a null text has no bytes and is a group of its own with all null texts; size is the bytes plus 1; nulls in other
columns are values like any other; repeated rows share a shard and have slots of their own; ties in all coordinates and the hash stay together;
a text of any length is one unit, so a shard may be as large as its largest text; an empty table gives an empty table. Extra columns
are not looked at; sharded replaces columns named shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .base import discard, park

BINS, LEAST, CELL_BITS, HASH_BITS, FINE = 1 << 14, 8, 20, 40, 0.0005
DIMENSIONS = ("c_bytes", "c_source", "c_lang", "c_id")
#: Rows that one task numbers, and the most nodes whose table is broadcast.
SLOT_BLOCK, MAX_BROADCAST = 65_536, 100_000


def _cell(value: Column, tie: Column) -> Column:
    """value in [0, 2**20) and the tie's 40 bits as one long."""
    top = F.least(F.greatest(F.floor(value), F.lit(0)), F.lit((1 << CELL_BITS) - 1)).cast("long")
    return F.shiftleft(top, HASH_BITS).bitwiseOR(F.shiftrightunsigned(tie, 64 - HASH_BITS))


def groups(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """rows (doc_id, source, lang, size, t1, t2) with doc_ids from low to high as units: t1, t2, weight and the coordinates."""
    units = rows.groupBy("t1", "t2").agg(F.sum("size").alias("weight"), F.min("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("id"))
    scale, low, high = float(1 << CELL_BITS), float(low or 0), float(high or 0)
    place = F.coalesce((F.col("id").cast("double") - F.lit(low)) / F.lit(max(high - low, 1.0)), F.lit(0.0))
    word = lambda c: F.pmod(F.coalesce(F.crc32(c), F.lit(0)), F.lit(1 << CELL_BITS))
    at = {"c_bytes": F.log2(F.col("size").cast("double")) / 40 * scale, "c_source": word("source"), "c_lang": word("lang"), "c_id": place * scale}
    tie = F.xxhash64("t1", "t2")
    return units.select("t1", "t2", "weight", *[_cell(v, tie).alias(k) for k, v in at.items()])


def _with(units: DataFrame, rows: list[tuple], schema: str, how: str = "inner") -> DataFrame:
    """units joined with a table of a row a node."""
    table = units.sparkSession.createDataFrame(rows, schema)
    return units.join(F.broadcast(table) if len(rows) <= MAX_BROADCAST else table, "node", how)


def quantiles(units: DataFrame, nodes: dict[int, dict]) -> None:
    """For each node (dim, lo, hi, total, goal) the mark in its dimension, from which on units go right: narrows [lo, hi] by histograms."""
    x = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
    for v in nodes.values():
        v |= {"below": 0, "w": v["total"]}  # below: the weight under lo, all of which goes left
    while open_ := {k: v for k, v in nodes.items() if v["hi"] > v["lo"] and v["w"] > FINE * v["total"]}:
        cells = max(LEAST, BINS // len(open_))
        for v in open_.values():
            v["wide"] = (v["hi"] - v["lo"]) // cells + 1
        near = _with(units, [(k, v["dim"], v["lo"], v["hi"], v["wide"]) for k, v in open_.items()], "node int, dim int, lo long, hi long, wide long").withColumn("x", x).filter("x >= lo AND x <= hi")
        hist: dict[int, list] = {}
        for r in near.groupBy("node", F.expr("(x - lo) div wide").alias("bin")).agg(F.sum("weight").alias("w")).collect():  # max(BINS, LEAST * nodes) rows
            hist.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for k, v in open_.items():
            upto = v["below"]
            for i, w in sorted(hist[k]):
                if upto + w >= v["goal"] or i == max(hist[k])[0]:
                    v |= {"lo": v["lo"] + i * v["wide"], "hi": min(v["lo"] + (i + 1) * v["wide"] - 1, v["hi"]), "below": upto, "w": w}
                    break
                upto += w
    for v in nodes.values():  # the cell that holds the quantile goes to the side that leaves the smaller error
        v["mark"] = v["hi"] + 1 if v["below"] + v["w"] - v["goal"] <= v["goal"] - v["below"] else v["lo"]


def leaves(units: DataFrame, shards: int) -> DataFrame:
    """units with node, the number of their shard: a node owes the shards node to node + owes - 1."""
    units, owes = park(units.withColumn("node", F.lit(0))), {0: shards}
    while open_ := [k for k, n in owes.items() if n > 1]:
        ends = [f(d).alias(f"{name}{i}") for i, d in enumerate(DIMENSIONS) for name, f in (("l", F.min), ("h", F.max))]
        inner = _with(units, [(k,) for k in open_], "node int") if len(open_) < len(owes) else units
        nodes = {}
        for r in inner.groupBy("node").agg(F.sum("weight").alias("total"), *ends).collect():  # a row a node
            dim = max(range(len(DIMENSIONS)), key=lambda i: ((r[f"h{i}"] >> HASH_BITS) - (r[f"l{i}"] >> HASH_BITS), -i))
            left = owes[r["node"]] // 2
            nodes[r["node"]] = {"dim": dim, "lo": r[f"l{dim}"], "hi": r[f"h{dim}"], "total": r["total"], "left": left, "goal": r["total"] * left / owes[r["node"]]}
        if not nodes:
            break
        quantiles(units, nodes)
        cuts = _with(units, [(k, v["dim"], v["left"], v["mark"]) for k, v in nodes.items()], "node int, dim int, left int, mark long", "left")
        right = F.coalesce(F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1) >= F.col("mark"), F.lit(False))
        new = park(cuts.select(F.when(right, F.col("node") + F.col("left")).otherwise(F.col("node")).alias("node"), "t1", "t2", "weight", *DIMENSIONS))
        discard(units)
        units = new
        for k in open_:
            left = owes[k] // 2
            owes[k], owes[k + left] = left, owes[k] - left
    return units


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(1), text))


def shard(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard, slot, and t1, t2, hashes of the text. Without shards, as many as keep a shard
    near target_bytes."""
    text = F.coalesce(docs["text"], F.lit(""))
    t1, t2 = _hashes(docs["text"])
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), t1.alias("t1"), t2.alias("t2"),
    )
    seen = Observation()
    rows = park(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    seen = seen.get
    if shards is None:
        shards = max(1, -(-(seen["bytes"] or 0) // (target_bytes or 1 << 30)))
    units = leaves(groups(rows, seen["low"], seen["high"]), shards)
    placed = rows.join(units.select("t1", "t2", F.col("node").alias("shard")), ["t1", "t2"])
    # slots: rows are numbered in blocks by hash, the blocks of a shard by a running count
    blocks = max(1, -(-seen["n"] // SLOT_BLOCK)) * 4
    placed = park(placed.withColumn("block", F.pmod(F.xxhash64(F.lit(7), "doc_id", "t1"), F.lit(blocks))))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).select("shard", "block", "base")
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "t1", "t2"))
    out = placed.withColumn("number", number).join(ahead, ["shard", "block"]).withColumn("slot", F.col("base") + F.col("number") - 1)
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "t1", "t2")


def op10(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with shard and slot, which replace columns of these names. Equal texts share a shard; rows equal in doc_id and text get their
    slots in any order."""
    placed = shard(docs, shards).withColumn("i", F.row_number().over(Window.partitionBy("t1", "t2", "doc_id").orderBy("slot")))
    k1, k2 = _hashes(docs["text"])
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    key = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), docs["doc_id"].cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"))
    key = key.withColumn("j", F.row_number().over(Window.partitionBy("k1", "k2", "id").orderBy("k1")))
    joined = key.join(placed, (key["k1"] == placed["t1"]) & (key["k2"] == placed["t2"]) & key["id"].eqNullSafe(placed["doc_id"]) & (key["j"] == placed["i"]))
    return joined.select("row.*", "shard", "slot")

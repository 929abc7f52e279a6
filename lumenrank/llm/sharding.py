"""Sharding by sampled splitters (operator 5), with built-in functions only.

Law ``bytes``: shard sizes are near equal. Rows are ordered by a 64-bit hash of the
text, so equal texts are neighbours, and the order is cut into ``shards`` stretches of
equal bytes:

1. A size-weighted sample of the keys (a row enters with a probability proportional to
   its size, decided by a hash of the row) gives quantile boundaries for ``ranges`` ranges.
2. Every row finds its range by binary search in the boundaries. Ranges are measured
   exactly, and an overfull one (more rows than ``OVERFULL`` mean ranges, or ``max_rows``) is
   subdivided by a second hash of the key. A group of equal texts that is overfull by itself
   follows its range as ranges of its own, subdivided by a hash of the row. So a group with a
   third of all rows is spread over many tasks, and yet stands together in the order.
3. The few range totals are summed up in order; inside a range a window gives each row
   its place and the bytes before it. Place and bytes decide shard and slot.

A group of equal texts stays in one shard, however many rows it has, unless its bytes are
more than ``GROUP_SHARE`` of a shard: then its rows are cut like any others. No task holds more than one (sub)range; the
only one-task window runs over the range totals.

Edge cases: a null text has size 1 and the checksum of the empty text; equal rows take
neighbouring slots; rows without an id are placed like others; a text of any length is one
row of its size; an empty table gives an empty result; fewer rows than shards leave shards
empty; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, written

SHARDS = 16
#: First-level ranges; a fixed number, as overfull ranges are subdivided.
RANGES = 256
#: Expected sample: rows per range.
SAMPLE_PER_RANGE = 64
#: Rows that one window task orders at most, by expectation.
MAX_ROWS = 500_000
#: A range is overfull from so many mean ranges on, but not with fewer rows than LEAST_ROWS.
OVERFULL, LEAST_ROWS = 2, 1000
#: Groups of equal texts up to this share of a shard's bytes are never cut.
GROUP_SHARE = 0.02


def splitters(keyed: DataFrame, total: int, ranges: int = RANGES) -> list[int]:
    """Boundaries between ranges: quantiles of a size-weighted sample of the keys."""
    want = float(ranges * SAMPLE_PER_RANGE)
    u = F.pmod(F.xxhash64(F.lit("sample"), "key", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chance = F.lit(want) * F.col("size") / F.lit(float(max(total, 1)))
    cuts = [i / ranges for i in range(1, ranges)]
    got = keyed.filter(u < chance).agg(F.percentile_approx("key", cuts, 10_000).alias("q")).first()["q"]
    return sorted(set(got or []))


def range_of(key, cuts: list[int]):
    """How many boundaries are below ``key``: a binary search as an expression."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"), bounds.alias("b"), key.alias("k"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        open_ = s["lo"] < s["hi"]
        below = open_ & (F.get(s["b"], mid) < s["k"])
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"), s["b"].alias("b"), s["k"].alias("k"))

    return F.aggregate(steps, state, halve, lambda s: s["lo"])


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          ranges: int = RANGES, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: ``(id_col, size, text_crc32, law, shard, slot, grown_shard)``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = written(df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")), "shard-keys")
    sums = keyed.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total = sums["bytes"] or 0
    quota = total / shards

    placed = keyed.withColumn("range", range_of(F.col("key"), splitters(keyed, total, ranges)))
    limit = min(max_rows, max(LEAST_ROWS, OVERFULL * (sums["rows"] or 0) // ranges))
    heavy = written(keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter(F.col("n") > limit).select(
        "key", F.ceil(F.col("n") / limit).cast("int").alias("own_parts"), F.col("bytes").alias("own_bytes")), "heavy-keys")
    # At most `ranges` rows, and at most rows / limit keys: proven bounds for the broadcasts.
    placed = placed.join(F.broadcast(heavy), "key", "left")
    parts = placed.filter("own_parts IS NULL").groupBy("range").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(parts), "range", "left")
    alone = F.col("own_parts").isNotNull()
    sub = F.when(alone, F.pmod(F.xxhash64(F.lit("sub"), "doc_id", "key"), F.col("own_parts").cast("long"))).otherwise(
        F.pmod(F.xxhash64(F.lit("sub"), "key"), F.col("parts").cast("long")))
    # Order: the range's rows, then its overfull groups one by one.
    unit = ["range", "alone", "own", "sub"]
    rows = written(placed.select("doc_id", "size", "text_crc32", "key", "range", alone.alias("alone"),
                                 F.when(alone, F.col("key")).otherwise(0).alias("own"), sub.cast("int").alias("sub"), "own_bytes"),
                   "shard-ranges")

    totals = rows.groupBy(*unit).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    before = Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*unit, F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    offsets = offsets.withColumn("own0", F.min("b0").over(Window.partitionBy("range", "alone", "own")))
    inside = Window.partitionBy(*unit).orderBy("key", "doc_id")
    run = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*unit, "key")
    rows = (rows.withColumn("b1", F.sum("size").over(run)).withColumn("n1", F.row_number().over(inside))
            .withColumn("g_end", F.max("b1").over(group)).withColumn("g_size", F.sum("size").over(group)))
    rows = rows.join(offsets, unit)
    bytes_ = F.when(F.col("alone"), F.col("own_bytes")).otherwise(F.col("g_size"))
    end = F.when(F.col("alone"), F.col("own0") + F.col("own_bytes")).otherwise(F.col("b0") + F.col("g_end"))
    middle = F.when(bytes_ <= F.lit(GROUP_SHARE * quota), end - bytes_ / 2).otherwise(F.col("b0") + F.col("b1") - F.col("size") / 2)
    number = F.least(F.floor(middle / F.lit(max(quota, 1e-9))), F.lit(shards - 1)).cast("int")
    rows = written(rows.select("doc_id", "size", "text_crc32", number.alias("shard"),
                               (F.col("n0") + F.col("n1") - 1).alias("place")), "shard-places")
    starts = rows.groupBy("shard").agg(F.min("place").alias("start"))
    # `shards` rows: a proven bound for the broadcast.
    return rows.join(F.broadcast(starts), "shard").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` in shards 0 to 15."""
    return shard(documents(spark, sf_dir))

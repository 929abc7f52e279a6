"""Exact dedup by a Golomb-coded fingerprint exchange (operator 3).

1. One pass over the texts: each Arrow batch normalises its texts (deletes the
   white space), hashes them, and writes its rows plus one message per owner: the
   batch's distinct 64-bit fingerprints of that owner's range, sorted, as
   Golomb-Rice coded gaps.
2. Owners decode the messages of their range, find fingerprints that occur more
   than once anywhere, and answer each message with a bitmap over its fingerprints.
3. Rows whose bit is set are suspects. Only they shuffle: they are grouped by the
   digest *and the normalised bytes themselves*, so equality is decided by bytes.

A batch sends each fingerprint once whatever its number of copies, so a group of
copies that holds a third of all rows is one entry per batch. The byte grouping
aggregates before its shuffle as well. No fingerprint reaches the driver.

Edge cases: a null text counts as empty; empty texts are equal to each other; of
equal length the smallest id stays, null ids last, and of fully equal rows the
first read; a text of any length is hashed and compared whole; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import SPACE_BYTES, documents, written

#: Rows per owner of a fingerprint range, so that one owner's fingerprints fit in one task at any size.
ROWS_PER_OWNER = 1_000_000
LEAST_OWNERS = 64
#: Groups with more than this share (1 / HEAVY) of the rows in groups are joined by broadcast: at most so many.
HEAVY = 1000


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Gaps of a sorted uint64 array, Golomb-Rice coded with parameter ``k``:
    the unary quotients as one bit string, then the k-bit remainders."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits)[:n]  # the unary part comes first and holds n ones
    quotients = np.diff(ends, prepend=-1) - 1
    start = (int(ends[-1]) // 8 + 1) * 8
    low = bits[start:start + n * k].reshape(n, k).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) | (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def rice_parameter(span: int, n: int) -> int:
    """log2 of the mean gap: n sorted values in a range of ``span``."""
    return max(0, (span // max(1, n)).bit_length() - 1)


def _fingerprint_batches(id_col: str, owners: int):
    span = (1 << 64) // owners

    def run(batches):
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            norm = [t.encode().translate(None, SPACE_BYTES) for t in texts]
            digests = [hashlib.sha256(x) for x in norm]
            fps = np.array([int.from_bytes(d.digest()[:8], "big") for d in digests], np.uint64)
            distinct, rank, here = np.unique(fps, return_inverse=True, return_counts=True)
            owner = (distinct // np.uint64(span)).clip(max=owners - 1).astype(np.int64)
            bounds = np.searchsorted(owner, np.arange(owners + 1))
            chunk = (part << 32) | no
            no += 1
            rows = len(texts)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk] * rows, pa.int64()), "owner": pa.array(owner[rank], pa.int32()),
                "slot": pa.array(rank - bounds[owner[rank]], pa.int32()), "row": pa.array(range(rows), pa.int32()),
                id_col: b.column(0), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "text_sha256": pa.array([d.hexdigest() for d in digests], pa.string()),
                "norm": pa.array([x.decode() for x in norm], pa.string()), "n": pa.nulls(rows, pa.int32()),
                "k": pa.nulls(rows, pa.int32()), "blob": pa.nulls(rows, pa.binary()), "again": pa.nulls(rows, pa.binary()),
            })
            sent = [o for o in range(owners) if bounds[o] < bounds[o + 1]]
            parts = [slice(bounds[o], bounds[o + 1]) for o in sent]
            size = [int(p.stop - p.start) for p in parts]
            ks = [rice_parameter(span, s) for s in size]
            blobs = [rice_encode(distinct[p] - np.uint64(o * span), k) for o, p, k in zip(sent, parts, ks)]
            again = [np.packbits(here[p] > 1).tobytes() for p in parts]
            m = len(sent)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk] * m, pa.int64()), "owner": pa.array(sent, pa.int32()),
                "slot": pa.nulls(m, pa.int32()), "row": pa.nulls(m, pa.int32()), id_col: pa.nulls(m, b.column(0).type),
                "n_chars": pa.nulls(m, pa.int64()), "text_sha256": pa.nulls(m, pa.string()),
                "norm": pa.nulls(m, pa.string()), "n": pa.array(size, pa.int32()), "k": pa.array(ks, pa.int32()),
                "blob": pa.array(blobs, pa.binary()), "again": pa.array(again, pa.binary()),
            })

    return run


def _answer(messages: pa.Table) -> pa.Table:
    """One owner: a bitmap per message, set where the fingerprint has several rows,
    in that batch or in any two."""
    lists = [rice_decode(*m) for m in zip(messages["blob"].to_pylist(), messages["n"].to_pylist(),
                                          messages["k"].to_pylist())]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, twice, assume_unique=True)
                           | np.unpackbits(np.frombuffer(again, np.uint8), count=len(x)).astype(bool)).tobytes()
               for x, again in zip(lists, messages["again"].to_pylist())]
    return pa.table({"chunk": messages["chunk"], "owner": messages["owner"], "bitmap": pa.array(bitmaps, pa.binary())})


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """Per row: ``(id_col, keep_id, group_size, kept, text_sha256)``. ``owners``: fingerprint
    ranges; by default their number follows the row count."""
    owners = owners or max(LEAST_OWNERS, -(-df.count() // ROWS_PER_OWNER))
    id_type = df.schema[id_col].dataType.simpleString()
    kept_cols = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = written(kept_cols.mapInArrow(
        _fingerprint_batches("id", owners),
        f"chunk long, owner int, slot int, row int, id {id_type}, n_chars long, text_sha256 string, "
        "norm string, n int, k int, blob binary, again binary"), "fingerprints")
    messages = sent.filter(F.col("blob").isNotNull()).select("chunk", "owner", "n", "k", "blob", "again")
    bitmaps = written(messages.groupBy("owner").applyInArrow(_answer, "chunk long, owner int, bitmap binary"), "bitmaps")

    rows = sent.filter(F.col("blob").isNull()).drop("n", "k", "blob", "again")
    byte = F.expr("cast(conv(hex(substring(bitmap, cast(slot div 8 as int) + 1, 1)), 16, 10) as int)")
    # The written bitmaps have a measured size: the planner broadcasts them only when small.
    suspects = rows.join(bitmaps, ["chunk", "owner"]).filter(
        F.bit_get(byte, F.expr("7 - slot % 8")) == 1)
    same_bytes = (suspects.groupBy("text_sha256", "norm").agg(F.count("*").alias("rows"))
                  .groupBy("text_sha256").agg(F.count("*").alias("texts"), F.sum("rows").alias("group_size")))
    first = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("id").isNull().alias("no_id"), "id", "chunk", "row"))
    keepers = suspects.groupBy("text_sha256").agg(first.alias("keep"))
    groups = written(
        same_bytes.join(keepers, "text_sha256").select(
            "text_sha256", "keep", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
                F.raise_error(F.lit("two different texts share a SHA-256 digest"))).alias("group_size")),
        "groups")
    # Groups that hold many rows are few (at most HEAVY): theirs are not gathered in a task.
    rows = rows.drop("norm")
    limit = (groups.agg(F.sum("group_size")).first()[0] or 0) // HEAVY + 1
    hot, other = groups.filter(F.col("group_size") > limit), groups.filter(F.col("group_size") <= limit)
    out = rows.join(F.broadcast(hot), "text_sha256").unionByName(
        rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti").join(other, "text_sha256", "left"))
    is_kept = F.coalesce((F.col("keep.chunk") == F.col("chunk")) & (F.col("keep.row") == F.col("row")), F.lit(True))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        is_kept.alias("kept"), "text_sha256")


def op3(spark, sf_dir: str) -> DataFrame:
    """Query: exact groups of all of ``documents``."""
    return exact_groups(documents(spark, sf_dir))


#: DuckDB twin of ``op3`` (distinct ids; the byte grouping on the normalised text itself).
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
"""

"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 10).

Texts become word sequences (``words``). The patterns are the item windows: every
13 consecutive words of an item, or the whole of a shorter item. Patterns of one
length form one ``Matcher``: a shift table over blocks of two words tells how far the
search may jump after a block (most blocks of a text are in no pattern, so it jumps
almost a whole window); where the shift is 0, the bucket of that suffix block, keyed
by the prefix block, holds the few patterns to compare word by word.

The corpus is read once, without a shuffle. The items travel to the tasks in blocks
of at most ``ITEM_BLOCK_BYTES`` of text; a benchmark of several blocks takes as many
passes, whose state is written in between, so what is broadcast never grows.

Edge cases: a null or empty text has no words and no hits; a null or empty item has
no window; items with the same id count once; an item without an id marks words but
has no id to report; an empty benchmark hits nothing; extra columns do not matter.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrank.llm.common import documents, written

WINDOW = 13
BLOCK = 2
ITEM_BLOCK_BYTES = 8 * 1024 * 1024
#: A document is contaminated when at least one word in this many is hit.
HIT_SHARE = 20

# Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: ASCII digits,
# letters and every byte of the non-ASCII characters; all else becomes a space.
_FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows(item: list[bytes], size: int = WINDOW) -> Iterable[tuple[bytes, ...]]:
    if not item:
        return
    size = min(size, len(item))
    for i in range(len(item) - size + 1):
        yield tuple(item[i:i + size])


class Matcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[int]]):
        self.length, self.block, self.patterns = length, min(BLOCK, length), patterns
        self.skip = length - self.block + 1  # after a block that is in no pattern
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict] = defaultdict(lambda: defaultdict(list))
        for p, owners in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block:end]
                self.shift[b] = min(self.shift.get(b, self.skip), length - end)
            self.buckets[p[length - self.block:]][p[:self.block]].append((list(p), sorted(owners)))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, text: list[bytes], hit: np.ndarray, owners: set[int]) -> None:
        """Mark the words inside occurrences and collect the owners of what occurs."""
        n, m, b, skip, shift = len(text), self.length, self.block, self.skip, self.shift.get
        end = m
        while end <= n:
            suffix = tuple(text[end - b:end])
            step = shift(suffix, skip)
            if step:
                end += step
                continue
            start = end - m
            for pattern, own in self.buckets[suffix].get(tuple(text[start:start + b]), ()):
                if text[start:end] == pattern:
                    hit[start:end] = True
                    owners.update(own)
            end += 1


def matchers(items: list[str | None]) -> list[Matcher]:
    """Tables for the windows of these item texts; owners are positions in ``items``."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for i, text in enumerate(items):
        for w in windows(words(text)):
            by_length[len(w)][w].add(i)
    return [Matcher(n, dict(patterns)) for n, patterns in sorted(by_length.items())]


def _pass(ids: list[str | None], blob, first: bool, keep_text: bool):
    def run(batches):
        found = [Matcher(n, p) for n, p in pickle.loads(blob.value)]
        for b in batches:
            out = {"n_words": [], "hits": [], "n_hit": [], "items": []}
            before = None if first else (b.column(2).to_pylist(), b.column(3).to_pylist())
            for i, t in enumerate(b.column(1)):
                text = words(t.as_py())
                hit, owners = np.zeros(len(text), bool), set()
                for m in found:
                    m.search(text, hit, owners)
                names = {ids[o] for o in owners if ids[o] is not None}
                if before:
                    hit |= np.unpackbits(np.frombuffer(before[0][i], np.uint8), count=len(text)).astype(bool)
                    names.update(before[1][i])
                out["n_words"].append(len(text))
                out["hits"].append(np.packbits(hit).tobytes())
                out["n_hit"].append(int(hit.sum()))
                out["items"].append(sorted(names))
            text_out = b.column(1) if keep_text else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), text_out, pa.array(out["hits"], pa.binary()), pa.array(out["items"], pa.list_(pa.string())),
                 pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64())],
                names=["row", "text", "hits", "items", "n_words", "n_hit"])

    return run


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterable:
    """One callable per block of bounded size; it fetches that block's ``(id as string, text)``."""
    items = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 32).alias("b")).first()["b"] or 0
    n = size // ITEM_BLOCK_BYTES + 1
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) if n > 1 else items
        yield lambda block=block: [(r["id"], r["text"]) for r in block.collect()]


def scan(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", keep_text: bool = True) -> DataFrame:
    """``(row struct of the other input columns, text, items array<string>, n_words,
    n_hit, contaminated)``; ``items`` lists the ids, as sorted strings, of the items
    with an occurring window; ``text`` is null without ``keep_text``."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text_col]
    state = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([state.schema["row"], state.schema["text"], T.StructField("hits", T.BinaryType()),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType()),
                           T.StructField("n_hit", T.LongType())])
    blocks = list(_item_blocks(items, item_id, item_text))
    for k, block in enumerate(blocks):
        found = block()
        tables = [(m.length, m.patterns) for m in matchers([t for _, t in found])]
        blob = spark.sparkContext.broadcast(pickle.dumps(tables))
        if k:
            state = written(state, "decontaminate")
        last = k == len(blocks) - 1
        state = state.mapInArrow(_pass([i for i, _ in found], blob, k == 0, keep_text or not last), schema)
    contaminated = (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("n_words"))
    return state.drop("hits").withColumn("contaminated", contaminated)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    kept = scan(docs, items, text_col).filter(~F.col("contaminated"))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents`` against all of ``benchmark``."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"),
                 spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: DuckDB twin of ``op10``: windows of each length that an item window has, joined as strings.
OP10_SQL = r"""
WITH fold AS (
  SELECT doc_id AS id, true AS is_doc, text FROM documents
  UNION ALL SELECT item_id, false, text FROM benchmark),
w AS (
  SELECT id, is_doc, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM fold),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(13, len(ws)) AS m,
         array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM w, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS t(i)
  WHERE NOT is_doc AND len(ws) > 0),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_windows AS (
  SELECT id AS doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM w, lengths, unnest(range(1, len(ws) - m + 2)) AS t(i)
  WHERE is_doc AND len(ws) >= m),
found AS (
  SELECT DISTINCT doc_id, i, d.m, item_id
  FROM doc_windows d JOIN item_windows p ON d.m = p.m AND d.win = p.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON w.id = hit.doc_id LEFT JOIN it ON w.id = it.doc_id
WHERE is_doc
"""

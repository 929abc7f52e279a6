"""N-gram Jaccard join with Bayesian candidate pruning (operator 8).

Documents are sets of word 5-grams (lower-cased words between white space; a text of
fewer words is one gram). Two different texts are linked when their sets' Jaccard
similarity is at least ``THRESHOLD``.

1. One pass computes MinHash values. ``BANDS`` bands of ``ROWS`` values propose
   candidates: a pair at the threshold shares a band except with probability 8e-6. Copies
   collapse by a key of their words, and inside a batch only the first text of each band
   value goes on; the others are linked to it at once. So a group that holds a third of
   all rows is one row per batch and band.
2. Connected components of the band links are the candidate sets. Each is cut into blocks
   of bounded size; one task per pair of blocks holds both blocks, whatever the set's size.
3. A task compares the MinHash values of its pairs in steps. After each step a pair is
   dropped when the posterior probability that its similarity reaches the threshold
   (uniform prior, binomial matches) is below ``TOLERANCE``; all that remain are verified
   exactly on their gram sets. Pairs never leave the task: it emits per text the number
   of its links and one edge to the smallest text it is connected with. All pairs of a
   candidate set are looked at, also those that share no band.
4. Components of these edges are the classes.

Edge cases: null, empty and blank texts have no grams, no links and a class of their own;
repeated rows and copies (the same words) are one text with the same class; of a class the
row with the smallest id is kept, null ids last, and of repeated rows the first read; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, written
from lumenrank.llm.graph import components
from lumenrank.llm.line_dedup import doc_key

GRAM = 5
THRESHOLD = Fraction(4, 5)
BANDS, ROWS = 64, 8
#: MinHash values compared per step, and in all, before the exact check.
STEP, COMPARED = 32, 256
TOLERANCE = 1e-9
#: A block holds about so many texts, and so many bytes of grams.
BLOCK_TEXTS, BLOCK_BYTES = 256, 4 * 1024 * 1024

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_PLACE = _RNG.integers(1, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """Word hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def grams(ws: list[bytes], hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, ws), np.uint64, len(ws))
    n = min(GRAM, len(ws))
    total = np.full(len(ws) - n + 1, np.uint64(n))
    for j in range(n):
        total += _mix(h[j:len(ws) - n + 1 + j] * _PLACE[j])
    return np.unique(_mix(total))


def minhash(g: np.ndarray) -> np.ndarray:
    """BANDS * ROWS 32-bit MinHash values of a gram set."""
    x = (g ^ (g >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(_MUL), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[i:i + 1024, None] * _MUL + _ADD).min(axis=0), out=out)
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit band values; the band's number is part of the value."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return _mix((parts * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def least_matches(threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """Per step: with fewer matches the posterior of reaching the threshold is below the
    tolerance. With a uniform prior it is P(Binomial(k + 1, t) <= matches)."""
    t, out = float(threshold), []
    for k in range(STEP, COMPARED + 1, STEP):
        tail, m = 0.0, -1
        while m < k:
            tail += comb(k + 1, m + 1) * t ** (m + 1) * (1 - t) ** (k - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m + 1)
    return out


def _sketch(batches):
    hashes = _Hashes()
    for b in batches:
        keys, nodes, sizes, first, sigs = [], [], [], {}, []
        for i, t in enumerate(b.column(2)):
            ws = words(t.as_py())
            key = hashlib.md5(b" ".join(ws)).digest()
            keys.append(key if ws else None)
            nodes.append(int.from_bytes(key[:8], "little", signed=True) if ws else None)
            g = None
            if ws and key not in first:
                first[key] = i
                g = grams(ws, hashes)
                sigs.append(minhash(g))
            sizes.append(len(g) if g is not None else None)
        heads, links = [[] for _ in keys], [[] for _ in keys]
        if sigs:
            at = list(first.values())
            values = band_values(np.stack(sigs)).astype(np.int64)
            for k in range(BANDS):
                v, head, group = np.unique(values[:, k], return_index=True, return_inverse=True)
                for j in np.flatnonzero(head[group] != np.arange(len(at))):
                    links[at[j]].append(nodes[at[head[group[j]]]])
                for x, j in zip(v.tolist(), head.tolist()):
                    heads[at[j]].append(x)
        yield pa.RecordBatch.from_pydict({
            "id": b.column(0), "doc": b.column(1), "key": pa.array(keys, pa.binary()),
            "node": pa.array(nodes, pa.int64()), "n": pa.array(sizes, pa.int64()),
            "heads": pa.array(heads, pa.list_(pa.int64())),
            "links": pa.array([sorted(set(x)) for x in links], pa.list_(pa.int64()))})


def _gram_sets(batches):
    hashes = _Hashes()
    for b in batches:
        sets = [grams(words(t.as_py()), hashes) for t in b.column(3)]
        sigs = [minhash(g)[:COMPARED].astype(np.uint16).tobytes() for g in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array([g.tobytes() for g in sets], pa.binary()),
             pa.array(sigs, pa.binary())], names=["component", "node", "blocks", "grams", "sig"])


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]):
    """The pairs ``(i, j)`` that no step drops."""
    matches = np.zeros(len(i), np.int64)
    for k, m in enumerate(least):
        step = slice(k * STEP, (k + 1) * STEP)
        matches += (left[i, step] == right[j, step]).sum(axis=1)
        keep = matches >= m
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def common_grams(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of ``sets[i]`` and ``sets[j]``."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1  # a gram of one set adds to no intersection
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [c, c + width])
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[lo:hi], column[lo:hi] - c] = 1
        total += dense @ dense.T
    return total[i, j].astype(np.int64)


def _verify(least: list[int], p: int, q: int):
    def run(group: pa.Table) -> pa.Table:
        node = group["node"].to_numpy()
        block = group["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group["grams"].to_pylist()]
        sig = np.stack([np.frombuffer(x, np.uint16) for x in group["sig"].to_pylist()])
        one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        if group["low"][0].as_py() == group["high"][0].as_py():
            i, j = np.triu_indices(len(node), 1)
        elif block.min() == block.max():  # the other block is empty
            i = j = np.zeros(0, np.int64)
        else:
            i, j = np.repeat(one, len(two)), np.tile(two, len(one))
        i, j = survivors(sig, sig, i, j, least)
        size = np.array([len(s) for s in sets], np.int64)
        both = common_grams(sets, i, j)
        linked = (p + q) * both >= p * (size[i] + size[j])
        i, j = i[linked], j[linked]
        count = np.bincount(i, minlength=len(node)) + np.bincount(j, minlength=len(node))
        root = np.arange(len(node))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(i.tolist(), j.tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        has = np.flatnonzero(count)
        return pa.table({"node": pa.array(node[has], pa.int64()), "links": pa.array(count[has], pa.int64()),
                         "to": pa.array([node[find(x)] for x in has], pa.int64())})

    return run


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: Fraction = THRESHOLD) -> DataFrame:
    """Per row: ``(id, doc, class_id, n_links, class_rows, kept)``; ``doc`` is the key of id
    and text (``doc_key``). ``class_id`` is the id of the row that is kept, ``n_links`` the
    number of different texts linked to this one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("doc", doc_key("id", "text"))
    id_type = rows.schema["id"].dataType.simpleString()
    sketch = written(rows.select("id", "doc", "text").mapInArrow(
        _sketch, f"id {id_type}, doc binary, key binary, node long, n long, heads array<long>, links array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "sketches")

    heads = sketch.select(F.explode("heads").alias("value"), "node")
    near = heads.select("node", F.min("node").over(Window.partitionBy("value")).alias("b")).filter("node != b")
    inside = sketch.select("node", F.explode("links").alias("b"))
    candidates = written(components(near.union(inside).withColumnRenamed("node", "a")), "candidates")

    # One row per text of a candidate set, with its grams, in blocks of bounded size.
    texts = sketch.filter("n IS NOT NULL").join(candidates, "node").groupBy("component", "node").agg(
        F.min("doc").alias("doc"), F.max("n").alias("n"), F.count_distinct("key").alias("keys"))
    texts = written(texts, "candidate-texts")
    blocks = texts.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).cast("int").alias("blocks"))
    sound = F.when(F.col("keys") == 1, F.col("node")).otherwise(
        F.raise_error(F.lit("two texts share a 64-bit node id")).cast("long"))
    wanted = written(texts.join(blocks, "component").select("component", sound.alias("node"), "blocks", "doc"), "wanted")
    # Rows that repeat in id and text fetch the same text: one of them goes on.
    # The join is the same at every size: texts are dealt once, unsorted, to the smaller side's hash tables.
    fetched = (rows.select("doc", "text").join(wanted.hint("shuffle_hash"), "doc").groupBy("component", "node", "blocks")
               .agg(F.first("text").alias("text")))
    sets = fetched.mapInArrow(_gram_sets, "component long, node long, blocks int, grams binary, sig binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    dealt = sets.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", "node", "block", F.least("block", "other").alias("low"),
                         F.greatest("block", "other").alias("high"), "grams", "sig")
    found = written(dealt.groupBy("component", "low", "high").applyInArrow(
        _verify(least_matches(threshold), threshold.numerator, threshold.denominator),
        "node long, links long, to long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    out = sketch.select("id", "doc", "row", "node").join(classes, "node", "left").join(links, "node", "left")
    # Texts without words stay alone: their class is their row.
    out = written(out.select("id", "doc", "row", "n_links", F.coalesce("component", "node").alias("class"),
                             F.when(F.col("node").isNull(), F.col("row")).alias("alone")), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    kept = written(out.groupBy("class", "alone").agg(first.alias("keep"), F.count("*").alias("class_rows")), "kept")
    same = F.col("c.class").eqNullSafe(F.col("k.class")) & F.col("c.alone").eqNullSafe(F.col("k.alone"))
    return out.alias("c").join(kept.alias("k"), same).select(
        "c.id", "c.doc", F.col("keep.id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "class_rows", (F.col("keep.row") == F.col("c.row")).alias("kept"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with its columns."""
    found = near_classes(docs, id_col, text_col).select("doc", "kept")
    kept = written(found.groupBy(F.col("doc").alias("__doc")).agg(
        F.count("*").alias("__rows"), F.sum(F.col("kept").cast("int")).alias("__kept")).filter("__kept > 0"), "kept-documents")
    out = docs.withColumn("__doc", doc_key(id_col, text_col)).join(kept.hint("shuffle_hash"), "__doc")
    # Rows without words are kept each; of rows that repeat in id and words, one stays.
    once = out.filter("__rows = __kept").unionByName(out.filter("__rows != __kept").dropDuplicates(["__doc"]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    """Query: classes and link counts of all of ``documents``."""
    out = near_classes(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "class_rows", "kept")

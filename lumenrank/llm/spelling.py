"""Spelling variant grouping by dense prefix-suffix tiling (operator 12).

Words are maximal runs of Latin letters with A-Z lower-cased. So that a clean corpus also
holds misspellings, a run loses one letter where a checksum of document and run asks for it
(``NOISE``). Words of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences count.

1. Counting. A task counts per document and over its batches, and sends a word once per
   flush of a bounded table; the sums are dealt by word.
2. Buckets. Two words differ by one insertion, deletion or replacement exactly when common
   prefix plus common suffix reach the longer length m minus one. Then they share the first
   m // 2 letters or the last m - m // 2, so a word is compared only with those that share
   one of these halves, as the longer (m its length) and as the shorter one (m one more).
3. Tiles. Each bucket is cut into blocks of bounded size, and each pair of blocks goes to
   one task: words become the rows of padded code-point matrices, aligned left and right,
   and all pairs of a tile are compared letter by letter at once. Small buckets share a
   tile. A pair counts in one tile only: by its prefix where that is long enough, else by
   its suffix. A tile emits per word how many near words it saw and the best of them, no
   pairs.
4. Forms. A word's form is its near word of largest count (ties: smallest in code-point
   order) where that is ``FACTOR`` times its own. Counts grow along forms, so they end;
   roots follow by pointer doubling in written tables.

Bounds: a bucket of any size is cut into blocks, so no task holds more than two blocks of
one bucket at a time; the comparisons of a bucket grow with the square of its distinct
words, not of their occurrences. Nothing but counts reaches the driver.

Edge cases: a null text has no words; a null id has the checksum of the empty string;
repeated rows count each; a text or a word of any length is taken whole; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, written

MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: A run loses the letter (checksum mod length) where NOISE divides the checksum.
NOISE = 199
#: Distinct words a counting task holds; characters from which a text is counted run by run.
HELD_WORDS, LONG_TEXT = 200_000, 1 << 20
#: Words per block, and letters; rows of a tile of small buckets; rows per task.
BLOCK_WORDS, BLOCK_LETTERS, TILE_ROWS, TASK_ROWS = 512, 1 << 20, 192, 100_000


# ------------------------------------------------------------------ words
def _count(min_length: int, noise: int, held: int):
    run = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")  # shorter runs give no word

    def count(batches):
        words: Counter[str] = Counter()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), pc.ascii_lower(pc.fill_null(b.column(1), ""))
            for i, t in zip(ids, texts):
                text = t.as_py()
                found = run.findall(text) if len(text) < LONG_TEXT else (m[0] for m in run.finditer(text))
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < min_length:
                            continue
                    words[word] += n
            if len(words) >= held:
                yield _counted(words)
                words.clear()
        yield _counted(words)

    return count


def _counted(words: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """``(word, n)``: the words that count."""
    found = df.select(id_col, text_col).mapInArrow(_count(min_length, noise, HELD_WORDS), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ------------------------------------------------------------------ tiles
def near_pairs(words: list[str], segment: np.ndarray, longer: np.ndarray, side: np.ndarray,
               by_suffix: np.ndarray) -> np.ndarray:
    """(rows, rows) booleans, above the diagonal: the pairs of a tile that count in it.

    Per row its bucket (``segment``), that bucket's m (``longer``) and kind, and ``side``:
    0 where all of a bucket's pairs are wanted, else 1 or 2 for pairs across."""
    n, length = len(words), np.array([len(w) for w in words], np.int32)
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    starts = np.cumsum(length) - length
    width = int(length.max())
    column = np.arange(len(flat)) - np.repeat(starts, length)
    row = np.repeat(np.arange(n), length)
    left, right = np.zeros((width, n), np.uint8), np.zeros((width, n), np.uint8)
    left[column, row] = flat
    right[np.repeat(length, length) - 1 - column, row] = flat
    wanted = (segment[:, None] == segment) & (np.arange(n)[:, None] < np.arange(n))
    wanted &= (side[:, None] == 0) | (side[:, None] != side)
    wanted &= (length == longer)[:, None] | (length == longer)
    shorter = np.minimum(length[:, None], length)

    def common(letters: np.ndarray) -> np.ndarray:
        alive, out = wanted.copy(), np.zeros((n, n), np.int32)
        for x in letters:
            alive &= x[:, None] == x
            if not alive.any():
                break
            out += alive
        return np.minimum(out, shorter)  # beyond their ends, padding is equal

    prefix = common(left)
    near = wanted & (prefix + common(right) >= np.maximum(length[:, None], length) - 1)
    return near & ~(by_suffix[:, None] & (prefix >= (longer // 2)[:, None]))


def _tile(rows: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("m", "ascending"), ("kind", "ascending"), ("part", "ascending"), ("low", "ascending"),
                               ("high", "ascending"), ("block", "ascending")])
        words, counts = table["word"].to_pylist(), table["n"].to_numpy()
        m, low, high, block = (table[c].to_numpy() for c in ("m", "low", "high", "block"))
        kind = table["kind"].to_numpy() == 1
        part = table["part"].combine_chunks().dictionary_encode().indices.to_numpy()
        change = [np.diff(x) != 0 for x in (m, kind.astype(int), part, low, high)]
        segment = np.concatenate([[0], np.cumsum(np.logical_or.reduce(change))]) if len(words) else np.zeros(0, int)
        bounds = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(words)]
        side = np.where(low == high, 0, np.where(block == low, 1, 2))
        out: dict[str, list] = {"word": [], "n_near": [], "form": [], "form_n": []}
        at = 0
        for lo, hi in zip(bounds[1:], [*bounds[2:], None]):
            if hi is not None and hi - at <= rows and (hi - at) * int(m[hi - 1]) <= BLOCK_LETTERS:
                continue  # the next bucket still fits into this tile
            own = slice(at, lo)
            near = near_pairs(words[own], segment[own], m[own], side[own], kind[own])
            near |= near.T
            seen = near.sum(axis=1)
            order = sorted(range(lo - at), key=lambda i: (-counts[at + i], words[at + i]))
            rank = np.empty(lo - at, np.int32)
            rank[order] = np.arange(lo - at, dtype=np.int32)
            best = np.where(near, rank, np.int32(lo - at)).min(axis=1)
            for i in np.flatnonzero(seen).tolist():
                j = at + order[best[i]]
                out["word"].append(words[at + i])
                out["n_near"].append(int(seen[i]))
                out["form"].append(words[j])
                out["form_n"].append(int(counts[j]))
            at = lo
        return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                         "form": pa.array(out["form"], pa.string()), "form_n": pa.array(out["form_n"], pa.int64())})

    return run


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, form, form_n)`` for the words of ``words (word, n)`` with near ones;
    ``form`` is the near word of largest count."""
    size = F.length("word")
    keys = []
    for m in (size, size + 1):
        half = F.floor(m / 2).cast("int")
        keys += [F.struct(m.alias("m"), F.lit(0).alias("kind"), F.substring("word", F.lit(1), half).alias("part")),
                 F.struct(m.alias("m"), F.lit(1).alias("kind"), F.substring(
                     "word", size - (m - half) + 1, m - half).alias("part"))]
    # Every word is in four buckets; a bucket without a word of its full length has no pairs.
    rows = words.select("word", "n", F.explode(F.array(*keys)).alias("bucket")).select("word", "n", "bucket.*")
    sizes = rows.groupBy("m", "kind", "part").agg(
        F.count("*").alias("words"), F.max(F.length("word")).alias("longest")).filter("words > 1 AND longest = m")
    blocks = F.greatest(F.ceil(F.col("words") / BLOCK_WORDS), F.ceil(F.col("words") * F.col("m") / BLOCK_LETTERS)).cast("int")
    sizes = written(sizes.select("m", "kind", "part", "words", blocks.alias("blocks")), "buckets")
    tasks = int((sizes.agg(F.sum(F.col("words") * F.col("blocks"))).first()[0] or 0) // TASK_ROWS + 1)
    dealt = rows.join(sizes.drop("words"), ["m", "kind", "part"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("word", "n", "m", "kind", "part", "block", F.least("block", "other").alias("low"),
                         F.greatest("block", "other").alias("high"))
    task = F.pmod(F.xxhash64("m", "kind", "part", "low", "high"), F.lit(tasks))
    found = dealt.withColumn("task", task).groupBy("task").applyInArrow(
        _tile(TILE_ROWS), "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


# ------------------------------------------------------------------ forms
def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms (word, form)``: where following forms ends."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while at.filter("moved").limit(1).count():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return at.select("word", "root")


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
             min_count: int = MIN_COUNT, factor: int = FACTOR, noise: int = NOISE) -> DataFrame:
    """Per word: ``(word, form, root, n, n_near, form_n)``."""
    words = written(word_counts(df, id_col, text_col, min_length, min_count, noise), "words")
    near = written(words.join(near_words(words), "word", "left"), "near-words")
    is_form = F.col("form_n") >= factor * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    ends = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    """Query: the words of all of ``documents``."""
    return variants(documents(spark, sf_dir))

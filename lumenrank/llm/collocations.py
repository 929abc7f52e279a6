"""Phrase collocation mining with counting quotient filters (operator 11).

Texts, with A-Z lower-cased, are cut into pieces at ``[.,;:!?]`` and line ends, and pieces
into words between blanks and tabs. Everything is counted per language (null: ``und``).

1. Chunks. One pass dictionary-encodes the texts: per chunk its distinct words and the
   sequence of their places, with a mark between pieces. The chunk table is written once.
2. Words. Chunks' words with their counts are dealt by word and sorted; one pass over the
   sorted rows adds them up, and numbers the words with ``MIN_COUNT`` occurrences. A phrase
   that often has no rarer words, so this loses no candidate. Chunks get the numbers back.
3. Phrases. Each chunk packs its pairs and triples of word ids, permutes them and counts
   them in a quotient filter (``quotient``), which it sends in ``2^f`` shards by its
   leading bits. Filters of a group of chunks merge shard by shard as sorted runs, are cut
   into finer shards and go to larger groups, until each shard has met all chunks: a few
   rounds, of as many rows per chunk, however many chunks there are.
4. Scores. Phrases with ``MIN_COUNT`` occurrences and their parts meet in joins over tables of
   such phrases only; scores are exact in decimals of 38 digits (totals up to 10^15).

Bounds: a chunk is cut within long texts, at the end of a piece; a merge task holds one
shard's numbers of at most ``2^f`` filters. A hot word or phrase is one row or slot per chunk.

Edge cases: a null text counts as empty; an empty text has no words; repeated rows count
each; ids are not read, nor are extra columns; ties in score and count go by the phrase's
bytes; a text of any length is counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, written
from lumenrank.llm.quotient import Filter, U, half_bits, pack, permute, restore, unpack

MIN_COUNT, TOP, CONTAINED, PARTS = 10, 2000, 50, 16
#: Tokens per chunk; bytes from which a text is cut at the ends of pieces; words per task; tokens
#: counted at once; log2 of the filters that one merge task takes.
CHUNK_TOKENS, LONG_TEXT, TASK_WORDS, SLICE, FAN_BITS = 1_500_000, 1 << 23, 1_000_000, 1 << 22, 8

# Every end of a piece becomes a full stop, which no word holds, and stands alone.
_FOLD = bytes(0x2E if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


# ------------------------------------------------------------------ chunks
class _Places(dict):
    """Places of a language's words in the chunk's list; 0 is the end of a piece."""

    def __init__(self, lang: bytes, words: list[bytes]):
        super().__init__({b".": 0})
        self.lang, self.words = lang + b"\n", words

    def __missing__(self, word: bytes) -> int:
        self.words.append(self.lang + word)  # no word holds a line end
        self[word] = n = len(self.words)
        return n


def _stretches(data: bytes, size: int):
    """A text in stretches that end with a piece."""
    at = 0
    while len(data) - at > size:
        end = data.find(b".", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def _chunks(tokens: int, long_text: int):
    def run(batches):
        part, no = TaskContext.get().partitionId(), 0
        words, codes, langs = [], array("i"), {}
        for b in batches:
            for i, text in enumerate(b.column(1)):
                if not text.is_valid:
                    continue
                lang = b.column(0)[i].as_py()
                lang = b"und" if lang is None else lang.encode()
                for data in _stretches(text.as_buffer().to_pybytes().translate(_FOLD), long_text):
                    places = langs.get(lang) or langs.setdefault(lang, _Places(lang, words))
                    codes.extend(map(places.__getitem__, data.replace(b".", b" . ").split()))
                    codes.append(0)
                    if len(codes) >= tokens:
                        yield _chunk(part, no, words, codes)
                        words, codes, langs, no = [], array("i"), {}, no + 1
        if words:
            yield _chunk(part, no, words, codes)

    return run


def _chunk(part: int, no: int, words: list[bytes], codes: array) -> pa.RecordBatch:
    seen = np.frombuffer(codes, np.int32)
    counts = np.bincount(seen, minlength=len(words) + 1)[1:].astype(np.int64)
    packed = pa.compress(seen.tobytes(), codec="zstd", asbytes=True)
    one = pa.array([0, len(words)], pa.int32())
    return pa.RecordBatch.from_pydict({
        "chunk": pa.array([(part << 32) | no], pa.int64()), "tokens": pa.array([len(seen)], pa.int64()),
        "codes": pa.array([packed], pa.binary()),
        "words": pa.ListArray.from_arrays(one, pa.array(words, pa.binary())),
        "counts": pa.ListArray.from_arrays(one, pa.array(counts, pa.int64()))})


# ------------------------------------------------------------------ words
def _number(min_count: int):
    """Over rows sorted by word: the totals of each word's rows, and numbers for the
    frequent ones. Of a word that goes on in the next batch, the rows are held back."""

    def run(batches):
        task, numbered, held, sums = TaskContext.get().partitionId(), 0, [], {}

        def flush(table: pa.Table):
            nonlocal numbered
            word = table["word"].combine_chunks()
            coded = word.dictionary_encode()  # in order of appearance, as the rows are sorted
            code, names = coded.indices.to_numpy(), coded.dictionary
            total = np.bincount(code, weights=table["n"].to_numpy()).astype(np.int64)
            often = total >= min_count
            number = numbered + np.cumsum(often) - 1
            numbered += int(often.sum())
            keep = often[code]
            for name, n in zip(names.to_pylist(), total.tolist()):
                lang = name[:name.rindex(b"\n")]
                sums[lang] = sums.get(lang, 0) + n
            rows, k = int(keep.sum()), int(often.sum())
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.concat_arrays([table["chunk"].combine_chunks().filter(pa.array(keep)), pa.nulls(k, pa.int64())]),
                "place": pa.concat_arrays([table["place"].combine_chunks().filter(pa.array(keep)), pa.nulls(k, pa.int32())]),
                "task": pa.array([task] * (rows + k), pa.int32()),
                "number": pa.array(np.concatenate([number[code][keep], number[often]]), pa.int64()),
                "word": pa.concat_arrays([pa.nulls(rows, pa.binary()), names.filter(pa.array(often))]),
                "n": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(total[often], pa.int64())])})

        for b in batches:
            if not b.num_rows:
                continue
            table, word = pa.Table.from_batches([b]), b.column("word")
            last = word[b.num_rows - 1]
            open_from = int(pc.index(word, last).as_py())
            if held and held[0]["word"][0] != last or not held:
                if held or open_from:
                    yield from flush(pa.concat_tables([*held, table.slice(0, open_from)]))
                held = [table.slice(open_from)]
            elif open_from:
                raise ValueError("rows are not sorted by word")
            else:
                held.append(table)
        if held:
            yield from flush(pa.concat_tables(held))
        if sums:
            k = len(sums)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.nulls(k, pa.int64()), "place": pa.nulls(k, pa.int32()), "task": pa.nulls(k, pa.int32()),
                "number": pa.nulls(k, pa.int64()), "word": pa.array(sums.keys(), pa.binary()), "n": pa.array(sums.values(), pa.int64())})

    return run


# ------------------------------------------------------------------ phrases
def _sent(found: Filter, group: int, shard_bits: int, fan: int) -> pa.Table:
    """A filter of a shard of ``shard_bits`` leading bits, in finer shards for the next round."""
    parts = list(found.shards(shard_bits + fan))
    return pa.table({
        "group": pa.array([group >> fan] * len(parts), pa.int64()), "shard": pa.array([s for s, _ in parts], pa.int64()),
        "filter": pa.array([f.encode(shard_bits + fan) for _, f in parts], pa.binary())})


def _phrases(bits: int, task_bits: int, fan: int, slice_tokens: int):
    """A chunk's pairs and triples of numbered words."""
    half = half_bits(bits)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [one(left.slice(i, 1), right) for i in range(left.num_rows)]
        return pa.concat_tables(out)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = np.frombuffer(pa.decompress(left["codes"][0].as_py(), decompressed_size=4 * left["tokens"][0].as_py(),
                                            codec="zstd"), np.int32)
        ids = np.zeros(left["size"][0].as_py() + 1, U)
        ids[right["place"].to_numpy() + 1] = (right["number"].to_numpy().astype(U) << U(task_bits)) + right[
            "task"].to_numpy().astype(U) + U(1)
        filters = []
        for lo in range(0, len(codes), slice_tokens):
            x = ids[codes[lo:lo + slice_tokens + 2]]  # phrases that start in this slice
            a, b, c = x[:-1], x[1:], np.append(x[2:], U(0)) if len(x) > 1 else x[:0]
            two = np.flatnonzero((a > 0) & (b > 0))
            two = two[two < slice_tokens]
            three = two[c[two] > 0]
            nothing = np.zeros(len(two), U)
            high, low = pack(np.concatenate([a[two], a[three]]), np.concatenate([b[two], b[three]]),
                             np.concatenate([nothing, c[three]]), bits)
            filters.append(Filter.of(half, *permute(high, low, half)))
        sent = _sent(Filter.merged(filters), 0, 0, fan)
        return sent.set_column(0, "group", pa.array([left["chunk"][0].as_py()] * sent.num_rows, pa.int64()))

    return run


def _merge(level: int, fan: int):
    def run(got: pa.Table) -> pa.Table:
        merged = Filter.merged([Filter.decode(x) for x in got["filter"].to_pylist()])
        return _sent(merged, got["group"][0].as_py(), level * fan, fan)

    return run


def _counted(bits: int, min_count: int):
    def run(got: pa.Table) -> pa.Table:
        merged = Filter.merged([Filter.decode(x) for x in got["filter"].to_pylist()])
        often = merged.counts >= min_count
        a, b, c = unpack(*restore(merged.high[often], merged.low[often], merged.half), bits)
        return pa.table({"i1": pa.array(a.astype(np.int64)), "i2": pa.array(b.astype(np.int64)),
                         "i3": pa.array(c.astype(np.int64)), "f": pa.array(merged.counts[often], pa.int64())})

    return run


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                  fan_bits: int = FAN_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(id, lang, word, f)``, ``(lang, n)`` and ``(i1, i2, i3, f)``: the frequent words, all word
    occurrences, and the frequent pairs (``i3`` = 0) and triples of word ids, per language."""
    chunks = written(df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        _chunks(CHUNK_TOKENS, LONG_TEXT), "chunk long, tokens long, codes binary, words array<binary>, counts array<long>"), "chunks")
    size = chunks.agg(F.count("*").alias("chunks"), F.sum(F.size("words")).alias("words")).first()
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select(
        "chunk", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    tasks = max(int(size["words"] or 0) // TASK_WORDS + 1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = written(rows.repartition(tasks, "word").sortWithinPartitions("word").mapInArrow(
        _number(min_count), "chunk long, place int, task int, number long, word binary, n long"), "word-numbers", free=True)
    most = numbered.agg(F.max("number").alias("number"), F.max("task").alias("task")).first()
    task_bits = int(most["task"] or 0).bit_length()
    # An id is the word's number in its task and then the task, from 1 on.
    bits = (((int(most["number"] or 0) << task_bits) | int(most["task"] or 0)) + 1).bit_length()
    text = F.decode("word", "UTF-8")
    name = F.substring_index(text, "\n", -1)
    language = F.substring(text, F.lit(1), F.length(text) - F.length(name) - 1)
    id_ = F.shiftleft(F.col("number"), task_bits) + F.col("task") + 1
    words = numbered.filter("word IS NOT NULL AND number IS NOT NULL").select(
        id_.alias("id"), language.alias("lang"), name.alias("word"), F.col("n").alias("f"))
    totals = numbered.filter("word IS NOT NULL AND number IS NULL").groupBy(F.decode("word", "UTF-8").alias("lang")).agg(
        F.sum("n").alias("n"))

    rounds = max(1, -(-max(1, int(size["chunks"]) - 1).bit_length() // fan_bits))
    fan = max(1, -(-max(1, int(size["chunks"]) - 1).bit_length() // rounds))
    fan = min(fan, half_bits(bits) // rounds) or 1
    left = chunks.select("chunk", "tokens", "codes", F.size("words").alias("size"))
    right = numbered.filter("chunk IS NOT NULL").select("chunk", "place", "task", "number")
    kind = "group long, shard long, filter binary"
    sent = left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(
        _phrases(bits, task_bits, fan, SLICE), kind)
    # Chunks meet by a hash of their number, ``fan`` bits less in each round.
    spread = F.pmod(F.xxhash64("group"), F.lit(1 << (fan * rounds)))
    sent = sent.withColumn("group", F.shiftright(spread, fan))
    for level in range(1, rounds):
        sent = sent.groupBy("group", "shard").applyInArrow(_merge(level, fan), kind)
    found = sent.groupBy("shard").applyInArrow(_counted(bits, min_count), "i1 long, i2 long, i3 long, f long")
    return words, totals, written(found, "phrases", free=True)


# ------------------------------------------------------------------ scores
def _score(a: str, left: str, right: str):
    """floor(10^6 a^2 / (left right)) in whole numbers."""
    wide = {c: f"cast({c} AS DECIMAL(15, 0))" for c in (a, left, right)}
    return F.expr(f"(cast(1000000 AS DECIMAL(7, 0)) * ({wide[a]} * {wide[a]})) div ({wide[left]} * {wide[right]})")


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                 top: int = TOP, contained: int = CONTAINED, fan_bits: int = FAN_BITS) -> DataFrame:
    """The ``top`` phrases of each language: ``(lang, rank, phrase, a, l, r, n, score)``."""
    words, totals, phrases = phrase_counts(df, lang_col, text_col, min_count, fan_bits)

    def word(i: str) -> DataFrame:
        return words.select(F.col("id").alias(f"i{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"))

    pairs, triples = phrases.filter("i3 = 0"), phrases.filter("i3 > 0")
    two = pairs.select("i1", "i2", F.col("f").alias("a")).join(
        words.select(F.col("id").alias("i1"), F.col("lang"), F.col("word").alias("w1"), F.col("f").alias("f1")), "i1").join(word("2"), "i2")
    inside = triples.select("i1", "i2", "f").unionByName(triples.select(F.col("i2").alias("i1"), F.col("i3").alias("i2"), "f"))
    inside = inside.groupBy("i1", "i2").agg(F.max("f").alias("longer"))
    two = two.join(inside, ["i1", "i2"], "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("a")))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"),
                     F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))

    first = pairs.select("i1", "i2", F.col("f").alias("f12"))
    last = pairs.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("f").alias("f23"))
    three = triples.withColumnRenamed("f", "a").join(first, ["i1", "i2"]).join(last, ["i2", "i3"]).join(
        words.select(F.col("id").alias("i1"), F.col("lang"), F.col("word").alias("w1"), F.col("f").alias("f1")), "i1").join(
        word("2").drop("f2"), "i2").join(word("3"), "i3")
    three = three.withColumn("s1", _score("a", "f1", "f23")).withColumn("s2", _score("a", "f12", "f3"))
    cut = F.when(F.col("s1") <= F.col("s2"), F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), F.col("s1").alias("score"))).otherwise(
        F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), F.col("s2").alias("score")))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut.alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # First within parts of a language, so that the last window gets no more than PARTS * top rows of it.
    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    ranked = two.unionByName(three).withColumn("part", part)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11(spark, sf_dir: str) -> DataFrame:
    """Query: the phrases of all of ``documents``."""
    return collocations(documents(spark, sf_dir))


#: DuckDB twin of ``op11``, with 128-bit products.
OP11_SQL = r"""
WITH cut AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM cut),
grams AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM pieces, unnest(range(1, len(w) + 1)) AS t(i)
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM pieces, unnest(range(1, len(w))) AS t(i)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM pieces, unnest(range(1, len(w) - 1)) AS t(i)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS p, array_to_string(w[k + 1:], ' ') AS q
  FROM c, unnest(range(1, size)) AS t(k)),
scored AS (
  SELECT x.lang, x.size, x.phrase, x.a, x.k, p.f AS l, q.f AS r,
         (1000000::HUGEINT * x.a * x.a) // (p.f::HUGEINT * q.f) AS score
  FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = x.p AND p.size = x.k
  JOIN f q ON q.lang = x.lang AND q.phrase = x.q AND q.size = x.size - x.k),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, size ORDER BY score, k) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT x.* FROM least x LEFT JOIN inside i ON i.lang = x.lang AND i.phrase = x.phrase AND x.size = 2
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * x.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

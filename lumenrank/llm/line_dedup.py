"""Line dedup by distributed prefix doubling (operator 6), with built-in functions only.

Every document is a sequence of line ids (a 128-bit hash of the line without white space at
its ends); blank lines, which have no words, take no part in it. Prefix doubling names the
runs that start at each position: round k names runs of 2^k lines by the pair of names at
the position and 2^(k-1) lines on, counts the names over the whole corpus, and keeps the
positions whose name occurs again. Positions of equal name are an interval of the suffix
array in which neighbours share a prefix of at least 2^k lines; a position that falls out
has no longer repeat. Only repeated lines enter at all, and only long repeats survive the
later rounds.

A repeated run counts from ``MIN_WORDS`` words ([^\\x20\\x09-\\x0D]+) on; as each line of a
sequence has one at least, rounds beyond log2(MIN_WORDS) are never needed. Where the same
run stands earlier (in a document of smaller id, or further up), its lines are deleted,
and with them the blank lines between two deleted ones.

The maximal repeated runs are found as unions of short ones: for each line, the shortest run
of so many words that starts there and the shortest that ends there, both among repeated
lines. Let a maximal run have an earlier copy, and take a line of it. The shortest run from
that line on either ends within the maximal run, or the line is within the shortest run
that ends with it; either way the line is in a short run inside the maximal one, which has
an earlier copy where the maximal one has, and so is deleted. Conversely a short run with
an earlier copy is part of a maximal one. Two overlapping names of a power of two identify
a short run exactly.

Hot lines and passages: names with more than a ``HEAVY``-th of all lines are at most HEAVY
many; what belongs to them is looked up by broadcast, all else by shuffled joins.

Edge cases: a null text stays null; an empty or blank text has no lines that count; rows
with the same id and text are one document (each gets the same result, neither deletes
from the other); null ids come last; ties between documents of one id go by their key; a
text of any length is split whole; an empty table gives an empty result; extra columns are
kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, written

MIN_WORDS = 50
#: At most so many names are hot.
HEAVY = 10_000
_BLANK = " \t\x0b\x0c\r"  # within a line


def _hash(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def doc_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of id and text; rows that agree in both are one document."""
    return _hash(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("\0")), "UTF-8"), F.encode(F.lit("\0"), "UTF-8"),
                 F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    """``(i, line)`` of the lines with words, in order, without white space at their ends."""
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_BLANK)).alias("line")))
    return F.filter(numbered, lambda x: x["line"] != "")


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, id, i, name, words)``: one row per line with words; ``i`` numbers these."""
    # Lines of blanks alone are emptied first, in the few texts where a line begins with a blank.
    text = F.col(text_col)
    maybe = F.substring(text, 1, 1).isin(*_BLANK)
    for blank in _BLANK:
        maybe = maybe | F.contains(text, F.lit("\n" + blank))
    text = F.when(maybe, F.regexp_replace(text, r"(?<![^\n])[ \t\x0B\x0C\r]++(?![^\n])", "")).otherwise(text)
    filled = F.array_remove(_lines(text), "")
    lines = docs.select(F.col(id_col).alias("id"), doc_key(id_col, text_col).alias("doc"), F.posexplode_outer(filled).alias("i", "x"))
    # An outer explode and a filter on its result: else the planner computes the array once more to see its size.
    lines = lines.filter("x IS NOT NULL")
    lines = lines.withColumn("line", F.btrim("x", F.lit(_BLANK)))
    # In most lines single blanks part the words; elsewhere the words themselves are counted.
    line, odd = F.col("line"), F.lit(False)
    for blank in ("  ", *_BLANK[1:]):
        odd = odd | F.contains(line, F.lit(blank))
    words = F.when(odd, F.regexp_count(line, F.lit(r"[^ \t\x0B\x0C\r]+"))).otherwise(
        F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    return lines.select("doc", "id", "i", _hash(F.encode("line", "UTF-8")).alias("name"), words.alias("words"))


def _by_name(rows: DataFrame, names: DataFrame, limit: int, how: str) -> DataFrame:
    """``rows`` joined on ``name`` to ``names (name, n, ...)``, one row a name. Those with ``n``
    over ``limit`` are few: their rows, which may be a third of all, are not shuffled."""
    heavy, light = names.filter(F.col("n") > limit), names.filter(F.col("n") <= limit)
    if not heavy.limit(1).count():
        return rows.join(light, "name", how)
    hot = F.broadcast(heavy)
    return rows.join(hot, "name", how).unionByName(
        rows.join(F.broadcast(heavy.select("name")), "name", "left_anti").join(light, "name", how))


def _repeated(rows: DataFrame, limit: int, step: str) -> DataFrame:
    """The rows whose name occurs more than once in the corpus; ``rows`` should be written."""
    again = written(rows.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"), f"names-{step}", free=True)
    return _by_name(rows, again, limit, "left_semi")


def repeated_runs(lines: DataFrame, limit: int, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, i, k, name)``: the name of the 2^k lines from ``i`` on, where it repeats.
    ``lines``: the repeated lines; ``limit``: occurrences from which a name is hot."""
    level = lines.select("doc", "i", "name")
    out = level.withColumn("k", F.lit(0))
    for k in range(1, max(1, min_words).bit_length()):
        half = 1 << (k - 1)
        on = Window.partitionBy("doc").orderBy("i").rangeBetween(half, half)
        pairs = level.withColumn("next", F.first("name").over(on)).filter("next IS NOT NULL")
        pairs = written(pairs.select("doc", "i", _hash("name", "next").alias("name")), f"pairs-{k}", free=True)
        level = written(_repeated(pairs, limit, str(k)), f"runs-{k}", free=True)
        out = out.unionByName(level.withColumn("k", F.lit(k)))
    return out


def shortest_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, id, a, b)``: the shortest runs of repeated lines with ``min_words`` words that
    start or end at each line. ``lines``: the repeated lines."""
    rows = lines.withColumn("stretch", F.col("i") - F.row_number().over(Window.partitionBy("doc").orderBy("i")))
    part = Window.partitionBy("doc", "stretch")
    rows = (rows.withColumn("upto", F.sum("words").over(part.orderBy("i")))
            .withColumn("before", F.col("upto") - F.col("words"))
            .withColumn("last", F.max("i").over(part)).withColumn("first", F.min("i").over(part))
            .withColumn("total", F.sum("words").over(part)))
    # The first line that begins with enough words behind it follows the run's last line;
    # the last line with enough words after it precedes the run's first line.
    after = F.min("i").over(part.orderBy("before").rangeBetween(min_words, Window.unboundedFollowing))
    ahead = F.max("i").over(part.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words))
    rows = rows.withColumn("after", after).withColumn("ahead", ahead)
    end = F.when(F.col("after").isNotNull(), F.col("after") - 1).when(
        F.col("total") - F.col("before") >= min_words, F.col("last"))
    start = F.when(F.col("ahead").isNotNull(), F.col("ahead") + 1).when(F.col("upto") >= min_words, F.col("first"))
    both = F.array(F.struct(F.col("i").alias("a"), end.alias("b")), F.struct(start.alias("a"), F.col("i").alias("b")))
    return (rows.select("doc", "id", F.explode(F.array_distinct(both)).alias("run"))
            .select("doc", "id", "run.a", "run.b").filter("a IS NOT NULL AND b IS NOT NULL"))


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, gone array<int>)``: per document, in order, the numbers of the lines with words
    that are later copies of repeated runs."""
    lines = written(line_table(docs, id_col, text_col), "lines")
    limit = max(1000, lines.count() // HEAVY)
    lines = written(_repeated(lines, limit, "0").dropDuplicates(["doc", "i"]), "repeated-lines", free=True)
    names = repeated_runs(lines, limit, min_words)
    k = F.floor(F.log2((F.col("b") - F.col("a") + 1).cast("double"))).cast("int")
    runs = shortest_runs(lines, min_words).withColumn("k", k)
    # A run of n lines is named by its first and its last 2^k lines, which overlap.
    runs = runs.withColumn("c", F.col("b") + 1 - F.pow(F.lit(2), F.col("k")).cast("int"))
    head = names.select("doc", F.col("i").alias("a"), "k", F.col("name").alias("head"))
    tail = names.select("doc", F.col("i").alias("c"), "k", F.col("name").alias("tail"))
    runs = runs.join(head, ["doc", "a", "k"]).join(tail, ["doc", "c", "k"])
    length = F.encode((F.col("b") - F.col("a") + 1).cast("string"), "UTF-8")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "doc", "a")
    runs = written(runs.select("doc", "id", "a", "b", _hash(length, F.col("head"), F.col("tail")).alias("name")),
                   "runs-found", free=True)
    first = written(runs.groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"),
                    "first-runs", free=True)
    later = _by_name(runs, first, limit, "inner").filter((F.col("first.doc") != F.col("doc")) | (F.col("first.a") != F.col("a")))
    gone = later.select("doc", F.explode(F.sequence("a", "b")).alias("i"))
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("i")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(row: struct of all input columns, text, n_lines, n_deleted)``: ``text`` without
    the deleted lines. Null texts have no lines."""
    gone = written(deletions(docs.select(id_col, text_col), id_col, text_col, min_words), "deleted-lines", free=True)
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(text_col).alias("text"),
                       doc_key(id_col, text_col).alias("doc"))
    # The same join at every size: texts are dealt once, unsorted, to the smaller side's hash tables.
    rows = rows.join(gone.hint("shuffle_hash"), "doc", "left").withColumn("lines", _lines(F.col("text")))
    n = F.greatest(F.size("lines"), F.lit(0))
    # Of the lines with words that go, their places in the text; up to the next one where that goes too.
    filled = F.when(F.col("gone").isNotNull(), F.transform(_filled(F.col("lines")), lambda x: x["i"]))
    rows = rows.withColumn("filled", filled)
    next_goes = lambda i, k: F.get("gone", k + 1) == i + 1
    cut = F.flatten(F.transform("gone", lambda i, k: F.sequence(
        F.get("filled", i), F.when(next_goes(i, k), F.get("filled", i + 1) - 1).otherwise(F.get("filled", i)))))
    rows = rows.withColumn("cut", F.when(F.size("filled") > 0, cut))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("cut"))
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    return rows.select("row", text.alias("text"), n.cast("long").alias("n_lines"),
                       F.greatest(F.coalesce(F.size("cut"), F.lit(0)), F.lit(0)).cast("long").alias("n_deleted"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of line runs deleted. A document of which nothing but
    blanks is left goes; ``n_chars``, where present, follows the new text."""
    out = dedup_lines(docs, id_col, text_col, min_words)
    out = out.filter((F.col("n_deleted") == 0) | (F.btrim("text", F.lit(_BLANK + "\n")) != ""))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col("text").alias(c)
        if c == "n_chars":
            return F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(
                docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*[column(c) for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents``; texts without later copies of repeated line runs."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_deleted", "text")


#: DuckDB twin of ``op6``, by the content of each line's shortest runs of 50 words.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, i - 1 AS i, ls[i] AS raw,
         list_filter(regexp_split_to_array(ls[i], '[\x20\x09-\x0D]+'), lambda x: x <> '') AS parts,
         trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
w AS (
  SELECT doc_id, i, line, len(parts) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS j,
         sum(len(parts)) OVER (PARTITION BY doc_id ORDER BY i) AS upto
  FROM l WHERE len(parts) > 0),
pairs AS (
  SELECT x.doc_id, x.j AS a, y.j AS b FROM w x JOIN w y
    ON x.doc_id = y.doc_id AND y.j >= x.j AND y.j < x.j + 50 AND y.upto - x.upto + x.words >= 50),
runs AS (
  SELECT doc_id, a, min(b) AS b FROM pairs GROUP BY doc_id, a
  UNION SELECT doc_id, max(a), b FROM pairs GROUP BY doc_id, b),
content AS (
  SELECT r.doc_id, a, b, string_agg(line, chr(10) ORDER BY j) AS c
  FROM runs r JOIN w ON w.doc_id = r.doc_id AND j BETWEEN a AND b GROUP BY r.doc_id, a, b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c, b - a ORDER BY doc_id, a) AS nth FROM content),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(a, b + 1)) AS j FROM ranked WHERE nth > 1)),
-- a blank line goes with the lines around it
around AS (
  SELECT l.doc_id, l.i, l.raw, len(l.parts) > 0 AS filled,
         count(*) FILTER (len(l.parts) > 0) OVER (PARTITION BY l.doc_id ORDER BY l.i) - 1 AS j FROM l),
kept AS (
  SELECT x.doc_id, count(*) AS n_lines,
         count(*) FILTER (g.j IS NOT NULL AND (x.filled OR h.j IS NOT NULL)) AS n_deleted,
         string_agg(CASE WHEN g.j IS NULL OR NOT (x.filled OR h.j IS NOT NULL) THEN raw END, chr(10) ORDER BY i) AS text
  FROM around x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.j = x.j
  LEFT JOIN gone h ON h.doc_id = x.doc_id AND h.j = x.j + 1 GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
       CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept USING (doc_id)
"""

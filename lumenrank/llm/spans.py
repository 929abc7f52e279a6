"""Match positions with built-in functions, shared by the scanners.

``split`` and ``regexp_extract_all`` walk the same matches from left to right, so the
pieces between matches and the matches themselves give every position as a running sum
of lengths, in code points. The running sum goes over blocks of ``BLOCK`` entries, so a
very long text with very many matches stays near linear.

Patterns are written so that Java's matcher neither recurses per repeat (possessive
groups) nor scans a run again from each of its characters (a look-behind that allows a
start only at the beginning of a run or where the last match ended, ``\\G``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512


def running_sum(lengths: Column) -> Column:
    """Sums of all entries before each entry."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest((n - 1) / BLOCK, F.lit(0)).cast("int")),
                         lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))

    def prefix(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.struct(first.alias("total"), F.array().cast("array<int>").alias("before")),
                           lambda s, x: F.struct((s["total"] + x).alias("total"),
                                                 F.array_append(s["before"], s["total"]).alias("before")),
                           lambda s: s["before"])

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    firsts = F.aggregate(blocks, start, lambda s, b: F.struct(
        (s["total"] + total(b)).alias("total"), F.array_append(s["before"], s["total"]).alias("before")),
        lambda s: s["before"])
    return F.flatten(F.zip_with(blocks, firsts, prefix))


def add_matches(df, text: str, out: str, pattern: str, guard: Column, group: int = 0, context: int = 0):
    """``df`` with ``out``: ``array<struct<at, start, end, found, part, before>>``, the
    leftmost non-overlapping matches. ``guard`` is a cheap condition without which a text
    has no match worth keeping; ``part`` is the text of ``group``; ``before``
    is the text from the match before on. With ``context`` also ``{out}_around``, from which
    ``surrounding`` takes so many characters."""
    none = F.array().cast("array<string>")
    pieces, hits, parts, lengths, starts = (f"_{out}_{x}" for x in ("pieces", "hits", "parts", "lengths", "starts"))
    df = (df.withColumn(pieces, F.when(guard, F.split(F.col(text), pattern, -1)).otherwise(none))
          .withColumn(hits, F.when(F.size(pieces) > 1, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none)))
    if group:
        df = df.withColumn(parts, F.when(F.size(pieces) > 1, F.regexp_extract_all(
            F.col(text), F.lit(pattern), F.lit(group))).otherwise(none))
    steps = F.zip_with(F.col(pieces), F.col(hits), lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))
    # A column of its own: the sums refer to it from inside a lambda, which must not compute it anew.
    df = df.withColumn(lengths, steps)
    df = df.withColumn(starts, F.when(F.size(hits) > 0, running_sum(F.col(lengths))).otherwise(F.array().cast("array<int>")))

    if context:
        # Each match with the piece before it, of which at most ``context`` characters at either end matter.
        units = F.zip_with(F.col(pieces), F.col(hits), lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
        df = df.withColumn(f"{out}_around", F.when(F.size(hits) > 0, F.transform(units, lambda u: F.struct(
            F.right(u, F.lit(context)).alias("tail"), F.left(u, F.lit(context)).alias("head")))))

    def span(h: Column, i: Column) -> Column:
        start = F.get(F.col(starts), i) + F.length(F.get(F.col(pieces), i))
        return F.struct(i.alias("at"), start.alias("start"), (start + F.length(h)).alias("end"), h.alias("found"),
                        (F.get(F.col(parts), i) if group else h).alias("part"),
                        F.get(F.col(pieces), i).alias("before"))

    return df.withColumn(out, F.transform(F.col(hits), span)).drop(pieces, hits, parts, lengths, starts)


def surrounding(out: str, s: Column, context: int) -> tuple[Column, Column]:
    """The ``context`` characters of the text before and after a match ``s`` of ``out``, whatever
    other matches stand there: a match has a character at least, so as many units hold them."""
    around, n = F.col(f"{out}_around"), F.lit(context)
    first = F.slice(around, F.greatest(s["at"] - n, F.lit(0)) + 1, F.least(s["at"], n))
    then = F.slice(around, s["at"] + 2, n)
    return (F.right(F.concat(F.array_join(first["tail"], ""), s["before"]), n), F.left(F.array_join(then["head"], ""), n))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined; spans carry ``start, order, end, kind``."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

"""Secret scans over an incremental blob ledger (operator 9), with built-in functions only.

A version is a path with a text; its blob is the text's SHA-256. The ledger records, for
each blob and rule version, the findings (also when there are none). A scan

1. addresses every version by content,
2. keeps the blobs that the ledger has not yet seen under this rule version,
3. takes one text per such blob (copies collapse before the shuffle, so a blob that a
   third of all paths share is one row per task) and scans each once,
4. adds the results to the ledger and joins the findings back to all paths; a blob that
   very many paths share is copied to several tasks, over which their rows are spread.

The query scans two versions of the corpus, as a nightly job would: first the documents
that came first (by a hash of the id, half of them), then all of them against the ledger
of that scan, which leaves only blobs not seen before to be scanned.

Edge cases: a null text counts as empty and shares the empty blob; equal rows and copies
share a scan; a rule change has a new version and scans everything anew; a ledger entry
that is there twice (a repeated append) counts once; a text of any length is scanned whole;
an empty table adds nothing and gives an empty result; positions are code points; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, written
from lumenrank.llm.spans import add_matches, joined

RULES_VERSION = 1
# (kind, pattern, group that is the secret, its least length). Runs shorter than the
# least length never match, which is the same as dropping them afterwards.
RULES = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
    ("pem", r"-----BEGIN\x20(?:[A-Z]++\x20)*+KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30),
]
BASE = ["assign", "access", "hex"]
#: Blobs with more than this share (1 / HOT_BLOBS) of all paths are hot.
HOT_BLOBS = 1000
LEDGER_SCHEMA = ("blob string, rules_version int, "
                 "spans array<struct<start: int, order: int, end: int, kind: string>>")


def _guard(kind: str, text: Column) -> Column:
    return {
        "assign": text.rlike("(?i:passw|secret|token|api_?key)"),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{24}"),
        "pem": F.contains(text, F.lit("-----BEGIN ")),
        "github": text.rlike("gh[pousr]_"),
        "jwt": F.contains(text, F.lit("eyJ")),
    }[kind]


def scan_texts(blobs: DataFrame) -> DataFrame:
    """``(blob, text)`` to ``(blob, spans)`` under the current rules."""
    for order, (kind, pattern, group, least) in enumerate(RULES):
        blobs = add_matches(blobs, "text", f"raw_{kind}", pattern, _guard(kind, F.col("text")), group)
        kept = F.filter(F.col(f"raw_{kind}"), lambda s: F.length(s["part"]) >= least)
        blobs = blobs.withColumn(kind, F.transform(kept, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))
        ).drop(f"raw_{kind}")
    return blobs.select("blob", F.concat(*[F.col(k) for k, *_ in RULES]).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         rules_version: int = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """``(findings, new entries)``: findings are ``(id_col, blob, scanned, spans)`` for every row
    of ``versions``, ``scanned`` where this scan had to read the blob; new entries are the
    ledger rows that this scan adds (append them)."""
    addressed = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    addressed = addressed.withColumn("blob", F.sha2("text", 256))
    paths = written(addressed.select("id", "blob"), "paths")
    texts = addressed.select("blob", "text")
    if ledger is not None:
        ledger = ledger.filter(F.col("rules_version") == rules_version).dropDuplicates(["blob"])
        unseen = written(paths.select("blob").distinct().join(ledger.select("blob"), "blob", "left_anti"), "unseen-blobs", free=True)
    # Copies collapse before anything is dealt by blob.
    one_each = texts.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        one_each = one_each.join(unseen, "blob", "left_semi")
    new = written(scan_texts(one_each).select("blob", F.lit(rules_version).cast("int").alias("rules_version"), "spans"),
                  "secret-ledger", free=True)
    known = new.withColumn("scanned", F.lit(True))
    if ledger is not None:
        known = ledger.select(*new.columns).withColumn("scanned", F.lit(False)).unionByName(known)
    limit = paths.count() // HOT_BLOBS + 1
    hot = paths.groupBy("blob").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(
        "blob", F.ceil(F.col("n") / limit).cast("int").alias("copies"))  # at most HOT_BLOBS rows
    hot = F.broadcast(written(hot, "hot-blobs", free=True))
    paths = paths.join(hot, "blob", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("copies")), F.lit(0)))
    known = known.join(hot, "blob", "left").withColumn("part", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.coalesce("copies", F.lit(1)).cast("bigint") - 1)))
    findings = paths.drop("copies").join(known.drop("copies", "rules_version"), ["blob", "part"]).select(
        F.col("id").alias(id_col), "blob", "scanned", "spans")
    return findings, new


def op9(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``, against the ledger of those that came first."""
    docs = documents(spark, sf_dir)
    first = docs.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0)
    _, ledger = scan(first)
    findings, _ = scan(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    return findings.select(
        "doc_id", *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "scanned")

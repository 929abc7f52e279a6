"""Personal data (operator 7), with built-in functions only and no shuffle.

Per kind a regular expression proposes spans and a validator confirms them (Luhn for
cards, mod-97 for IBANs, value ranges for addresses, digit counts for phones). Every
confirmed span gets a score: the kind's prior, raised when a context word stands near
it. The base kinds (email, ip, card, phone) are always reported; the kinds that the
method adds (iban, ssn) only from ``MIN_SCORE`` on, which an ``ssn`` reaches with a
context word alone.

Edge cases: a null text counts as empty and has no spans; equal rows get equal results;
an empty table gives an empty result; positions are code points of the whole text, however
long; an added span may overlap a base span; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrank.llm.common import documents
from lumenrank.llm.spans import add_matches, joined, surrounding

#: Characters on either side in which a context word counts.
CONTEXT = 40
MIN_SCORE = 0.7
CONTEXT_BONUS = 0.3

# (kind, pattern, prior, context words). An email's local part is a whole run of its
# class, or what follows the last match; the same holds for digits of an ip.
KINDS = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9,
     "e?mails?|contact|write"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|addresses|hosts?|servers?"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, "cards?|visa|credit|payments?"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "phones?|calls?|tel|mobile|fax"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8,
     "iban|accounts?|bank|transfers?"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social security|tax id"),
]
BASE = ["email", "ip", "card", "phone"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string: from the right, every second digit is doubled."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.when(
        (n - i) % 2 == 0, _at(digits, i)).otherwise(_at(digits, i) * 2 - F.when(_at(digits, i) > 4, 9).otherwise(0)))
    return (n > 0) & (total % 10 == 0)


def _at(s: Column, i: Column) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def mod97(iban: Column) -> Column:
    """ISO 13616: the country and check characters move to the end, letters count 10 to 35."""
    s = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    rest = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)
    return F.length(s).between(15, 34) & (rest == 1)


def _guard(kind: str, text: Column) -> Column:
    """Cheap tests without which no span of the kind can be confirmed."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": F.contains(text, F.lit("+")),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        "ssn": text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    }[kind]


def _valid(kind: str, found: Column) -> Column:
    octet = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    digits = _digits(found)
    return {
        "email": F.lit(True),
        "ip": found.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        "card": F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(10, 15),
        "iban": mod97(found),
        "ssn": ~found.rlike("^(?:000|666|9[0-9]{2})-|-00-|-0000$"),
    }[kind]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans)``; spans: ``array<struct<start, order, end, kind, found, score>>``."""
    df = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for order, (kind, pattern, prior, context) in enumerate(KINDS):
        df = add_matches(df, "text", f"raw_{kind}", pattern, _guard(kind, F.col("text")), context=CONTEXT)

        def scored(s: Column) -> Column:
            near = F.concat_ws("\n", *surrounding(f"raw_{kind}", s, CONTEXT))
            score = F.lit(prior) + F.when(F.lower(near).rlike(rf"\b(?:{context})\b"), CONTEXT_BONUS).otherwise(0.0)
            return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
                            F.lit(kind).alias("kind"), s["found"].alias("found"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

        valid = F.filter(F.col(f"raw_{kind}"), lambda s: _valid(kind, s["found"]))
        df = df.withColumn(kind, F.transform(valid, scored)).drop(f"raw_{kind}", f"raw_{kind}_around")
    kinds = [k for k, *_ in KINDS]
    sure = [F.col(k) if k in BASE else F.filter(F.col(k), lambda s: s["score"] >= MIN_SCORE) for k in kinds]
    return df.select(F.col("id").alias(id_col), F.concat(*sure).alias("spans"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Query: personal data in every whole text of ``documents``, with each span's score."""
    found = find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    # In the order of ``spans``, in hundredths.
    scores = F.array_join(F.transform(F.array_sort("spans"), lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select(
        "doc_id", *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))

import hashlib
import re

import corpus_pipeline as C
from lumenrank.llm import quality

from tests.conftest import SF01
from tests.llm import test_decontaminate as dec
from tests.llm import test_line_dedup as lines
from tests.llm import test_near_dup as near


def written(spark, df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def as_dict(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    before = as_dict(docs)

    docs = written(spark, C.accept_quality(spark, docs, SF01), tmp_path, "quality")
    assert docs.columns == columns
    kept = as_dict(docs)
    scores = {r["__row"]["doc_id"]: r["accepted"] for r in quality.classify(
        spark.read.parquet(f"{SF01}/documents.parquet"), labels).collect()}
    assert kept == {i: t for i, t in before.items() if scores[i]}
    marked = {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()}
    bad = [i for i, (q, t) in marked.items() if q == 0 or t == 1]
    good = [i for i in marked if i not in set(bad)]
    assert sum(i in kept for i in good) > 0.98 * len(good)
    assert sum(i in kept for i in bad) < 0.25 * len(bad)  # 399 labels; test_quality has more

    docs = written(spark, C.delete_repeated_lines(spark, docs, SF01), tmp_path, "lines")
    assert docs.columns == columns
    want = fast_lines(kept)
    got = as_dict(docs)
    assert got == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] != kept[r["doc_id"]])

    docs = written(spark, C.keep_one_of_each_class(spark, docs, SF01), tmp_path, "near")
    assert docs.columns == columns
    classes = near.brute(sorted(got.items()))
    assert as_dict(docs) == {i: t for i, t in got.items() if classes[i][0] == i}

    got = as_dict(docs)
    docs = written(spark, C.drop_contaminated(spark, docs, SF01), tmp_path, "clean")
    assert docs.columns == columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()]
    grams = {tuple(dec.brute_words(t)[i:i + 13]) for _, t in items for i in range(max(1, len(dec.brute_words(t)) - 12))}
    assert as_dict(docs) == {i: t for i, t in got.items() if not contaminated(dec.brute_words(t), grams)}

    out = {r["doc_id"]: r["decoded_sha256"] for r in C.encode_tokens(spark, docs, SF01).collect()}
    assert out == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in as_dict(docs).items()}
    assert {r["doc_id"] for r in C.run(spark, SF01).collect()} == set(out)


def contaminated(ws, grams):
    hit = set()
    for n in {len(g) for g in grams}:
        for i in range(len(ws) - n + 1):
            if tuple(ws[i:i + n]) in grams:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(ws)


def fast_lines(texts, min_words=50):
    """Like ``test_line_dedup.brute``, by the shortest runs only."""
    seen, out = {}, {}
    for i, t in sorted(texts.items()):
        raw = t.split("\n")
        at = [k for k, x in enumerate(raw) if x.strip(" \t\x0b\x0c\r")]
        ls = [raw[k].strip(" \t\x0b\x0c\r") for k in at]
        ws = [len(re.split("[ \t\x0b\x0c\r]+", x)) for x in ls]
        runs = set()
        for a in range(len(ls)):
            total, b = 0, a
            while b < len(ls) and total < min_words:
                total += ws[b]
                b += 1
            if total >= min_words:
                runs.add((a, b))
            total, s = 0, a + 1
            while s > 0 and total < min_words:
                s -= 1
                total += ws[s]
            if total >= min_words:
                runs.add((s, a + 1))
        gone = set()
        for a, b in sorted(runs):
            if seen.setdefault(tuple(ls[a:b]), (i, a)) != (i, a):
                gone.update(range(a, b))
        cut = {at[j] for j in gone} | {k for j in gone if j + 1 in gone for k in range(at[j], at[j + 1])}
        text = "\n".join(x for k, x in enumerate(raw) if k not in cut)
        if not gone or text.strip(" \t\x0b\x0c\r\n"):
            out[i] = text
    return out


def test_fast_lines_is_the_brute_force():
    rows = lines.made(4)
    want = lines.brute(rows, 9)
    got = fast_lines(dict(rows), 9)
    for i, _ in rows:
        text, _, n = want[False, i]
        assert got.get(i) == (text if not n or text.strip(" \t\x0b\x0c\r\n") else None)


def test_empty_and_null_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "plain words here", "en", "s", 16)]):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(C.STAGES):
            docs = written(spark, stage(spark, docs, SF01), tmp_path, f"{len(rows)}-{k}")
        assert docs.count() == len(rows)

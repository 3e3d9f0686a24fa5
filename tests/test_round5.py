"""What the fourth review found."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mailloom.operators import tfidf
from mailloom.plans import catalogue

from .test_oracle import rows

TEXTS = ["", "word", "é", "é\u00a0\u00a0 and é\u0436", "\u00ff\u0436" * 60, "a " * 100, "\n", " "]


def against_sql(spark, folder, name):
    """A query's rows and its SQL's over texts that stand alone in their messages (document numbers 13 and 15 modulo 16)."""
    docs = [(16 * k + last, x, "en", "src1", len(x)) for k, x in enumerate(TEXTS) for last in (13, 15)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    cur = con.execute(catalogue.SQL[name])
    df = catalogue.QUERIES[name](spark, str(folder))
    return rows(df.columns, df.collect()), rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", ["mime_round_trip", "mime_parse"])
def test_odd_bodies(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name)
    assert got == want and len(got) == 2 * len(TEXTS)


@pytest.mark.parametrize("slice_bytes", [40, 4 << 20])
def test_character_grams(spark, monkeypatch, slice_bytes):
    """texts go to the workers whole, not a list of letters each, and are counted as numbers; repeated and null keys, any letters, wherever batches are cut."""
    monkeypatch.setattr(tfidf, "SLICE_BYTES", slice_bytes)
    texts = [(1, "abcab 😀 é"), (1, "abcabc"), (1, "x" * 50), (2, ""), (3, "ab"), (None, "abc"), (None, "bcd" * 20), (4, None), (5, "дом дом\x00"), (6, "abc")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = Counter((i, (t or "")[k : k + n]) for i, t in texts for n in (3, 4, 5) for k in range(len(t or "") - n + 1))
    out = tfidf.term_counts(df, tfidf.pieces("char", F.col("text")), "char")
    got = [((r["doc_id"], r["term"]), r["tf"]) for r in out.collect()]
    assert dict(got) == want and len(got) == len(want)
    totals = tfidf.document_counts(df, tfidf.pieces("char", F.col("text")), "char")
    assert "split" not in totals._jdf.queryExecution().executedPlan().toString()
    each = Counter(term for _, term in want)
    assert {r["term"]: (r["df"], r["total"]) for r in totals.collect()} == {t: (n, sum(v for (_, x), v in want.items() if x == t)) for t, n in each.items()}


def test_character_grams_of_many_letters():
    """Five letters of a large alphabet are no number of 64 bits: they are numbered anew."""
    r = np.random.default_rng(3)
    texts = ["".join(map(chr, r.integers(0x3400, 0x9000, 9000))), "".join(map(chr, r.integers(0x20000, 0x20004, 500))), "abcde"]
    terms, place, who, tf = tfidf._char_grams(pa.array(texts), np.array([0, 1, 0]), 2)
    got = {(int(w), terms[int(p)].as_py()): int(n) for p, w, n in zip(place, who, tf, strict=True)}
    assert got == Counter((k % 2, t[i : i + n]) for k, t in enumerate(texts) for n in (3, 4, 5) for i in range(len(t) - n + 1)) and len(got) == len(tf)


def test_serving_works_each_text_out_once(spark):
    """the slicer and the mask chain stand once in the plan for a body, the chain once for a subject."""
    plan = catalogue.QUERIES["serve_clean"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transcript of session follows") == 1
    assert plan.count("[IP_ADDRESS]") == 2

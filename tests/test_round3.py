"""What the third review found, each on a few rows that went wrong before."""

import duckdb
from pyspark.sql import functions as F

from mailloom.functions import masking as mk
from mailloom.plans import catalogue
from mailloom.sources import html


def test_phone_edges_as_in_sql(spark):
    """Two numbers that share the character between them, and ends of text and line."""
    texts = ["x 12345678a87654321 y", "190.234.5678 190.234.5678", "12345678\n87654321\n", "12345678\n", "", "a12345678b12345678c12345678"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, body string")
    got = {r.doc_id: r.b for r in df.select("doc_id", mk.mask_one(F.col("body"), "phone", unicode=False).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == duckdb.execute(f"SELECT {catalogue.mask_sql('body', 'phone')} FROM (SELECT ? AS body)", [t]).fetchone()[0]
    assert got[0] == "x [PHONE_NUMBER]a87654321 y"


def test_open_references_stay(spark, tmp_path):
    """References without a semicolon, or that the SQL doesn't know, stay as written; the product resolves them."""
    pages = [(0, "<p>a&amp b</p>"), (1, "<p>en.&amp;&amp;&amp</p><p>x &copy y &eacute; &amp;lt; &lt;i&gt; z &#39;q&#39;</p>"), (2, None), (3, "<p>&</p>&am")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.body for r in catalogue.QUERIES["html_text_parsed"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = dict(con.execute(catalogue.SQL["html_text_parsed"]).fetchall())
    assert {k: v for k, v in got.items() if k != 2} == {k: v for k, v in want.items() if k != 2}
    assert got[0] == "a&amp b" and html.clean(pages[0][1]) == "a& b"


def test_one_timer_for_a_key():
    """A key with many stretches is read once when they close together, and has one timer."""
    from pyspark.sql import Row

    from mailloom.streaming.keyed import Silence

    class Handle:
        def __init__(self):
            self.rows, self.timers, self.reads = [], set(), 0

        def getListState(self, *_):
            return self

        def get(self):
            self.reads += 1
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def registerTimer(self, t):
            self.timers.add(t)

        def listTimers(self):
            return iter(set(self.timers))

        def deleteTimer(self, t):
            self.timers.remove(t)

    class Now(int):
        getExpiryTimeInMs = getCurrentWatermarkInMs = lambda self: int(self)

    h, s = Handle(), Silence(10)
    s.init(h)
    list(s.handleInputRows((7,), iter([Row(7, 100 * k, None) for k in range(50)]), None))
    assert h.timers == {10}
    h.timers.clear()
    out = list(s.handleExpiredTimer((7,), Now(4000), Now(10)))
    assert [tuple(r) for r in out] == [(7, 100 * k, 100 * k, 1) for k in range(40)]
    assert h.reads == 2 and h.timers == {4010} and len(h.rows) == 10


def test_terms_of_repeated_keys(spark):
    """Rows of one key, or of null, in several batches count as one text; terms themselves are not moved."""
    from collections import Counter

    from mailloom.operators import tfidf

    rows = [(k, t) for k in (1, 2, None) for t in ("a b a", "", "b a b", None, "a b c d")] + [(3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        out = tfidf.term_counts(df, tfidf.pieces("word", F.col("text")), "word")
        got = {(r.doc_id, r.term): r.tf for r in out.collect()}
        totals = {r.term: (r.df, r.total) for r in tfidf.document_counts(df, tfidf.pieces("word", F.col("text")), "word").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = Counter()
    for k, t in rows:
        w = (t or "").split()
        want.update((k, x) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))])
    assert got == want
    assert totals == {t: (sum(k[1] == t for k in want), sum(n for k, n in want.items() if k[1] == t)) for t in {k[1] for k in want}}
    assert "hashpartitioning(term" not in out._jdf.queryExecution().executedPlan().toString()


def test_batches_are_limited(spark):
    from mailloom.sources.tables import table

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    table(spark, "/root/testdata/sf0.001", "documents")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_language_grams_of_short_and_repeated_rows(spark):
    """N-grams come from Arrow batches: fewer characters than an n-gram has are one, and rows of a key count together."""
    import pyarrow as pa

    from mailloom.operators import language

    term, row = language.grams(pa.array([list(" ab "), list("  "), None, [], list("   ")]), 3)
    assert sorted(zip(row.tolist(), term.to_pylist())) == [(0, " ab"), (0, "ab "), (1, "  "), (3, ""), (4, "   ")]
    docs = spark.createDataFrame([(1, "aaaa bbbb aaaa bbbb", "x"), (2, "cccc dddd cccc dddd", "y"), (3, "aaaa bbbb aaaa bbbb", None), (3, "cccc dddd cccc dddd cccc dddd", None), (4, "short", None), (5, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.language for r in language.detect(docs, language.fit(docs)).collect()}
    assert got == {1: "x", 2: "y", 3: "y", 4: "unknown", 5: "unknown"}

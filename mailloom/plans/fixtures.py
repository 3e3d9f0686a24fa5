"""The message view that the queries run over, made from the documents table.

A document's number chooses one of sixteen forms; each keeps the whole text and adds to it
what some operator looks for. The expressions are written once and mean the same in Spark
and in standard SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.sources.tables import table

BODY = """CASE doc_id % 16
WHEN 0 THEN concat(text, chr(10), '-----Original Message-----', chr(10), 'From: a@b.example')
WHEN 1 THEN concat(text, chr(10), 'On Mon, Jan 1, 2001 at 12:00 PM, Jane Roe wrote:', chr(10), '> quoted')
WHEN 2 THEN concat(text, chr(10), '________________', chr(10), 'footer')
WHEN 3 THEN concat(text, chr(10), 'Visit https://login.example', cast(doc_id % 7 as string), '.co.uk/p?id=', cast(doc_id as string), ').')
WHEN 4 THEN concat(text, chr(10), 'see www.sub.host-', cast(doc_id as string), '.example.org, or evil-corp.ru/verify.')
WHEN 5 THEN concat(text, chr(10), 'Ref: TKT-', cast(10000 + doc_id as string), ' IBAN DE44500105175407324931 by J.R.R. @user', cast(doc_id as string))
WHEN 6 THEN concat(text, chr(10), 'attachment: x', cast(doc_id as string), ' report.pdf C:', chr(92), 'tmp', chr(92), 'a.txt /usr/local/a.sh')
WHEN 7 THEN concat(text, chr(10), '==========', chr(10), 'Dear [RECEIVER], click [ACTION_LINK]', chr(10), '[SENDER]')
WHEN 8 THEN concat('-----BEGIN PGP SIGNATURE-----', chr(10), 'iQEz', chr(10), '-----END PGP SIGNATURE-----', chr(10), text)
WHEN 9 THEN concat(text, ' 😀😀 ☺')
WHEN 10 THEN concat('pаypаl \u200b\u00a0ж', text)
WHEN 11 THEN concat('<html><head><title>Title ', cast(doc_id as string), '</title></head><body><p>', text, '</p><a href="http://a.b.example.com/x">go</a></body></html>')
WHEN 12 THEN concat('mv 00001.0123456789abcdef0123456789abcdef 00001.0123456789abcdef0123456789abcdef', chr(10), text)
WHEN 14 THEN concat(text, '   ', chr(10), chr(10), chr(10), chr(10), '+1-800-555-01', cast(10 + doc_id % 90 as string), chr(13), chr(10), 'end')
ELSE text END"""
SUBJECT = """concat(CASE doc_id % 8 WHEN 0 THEN 'Returned mail: ' WHEN 1 THEN 'Out of Office: ' WHEN 2 THEN '' WHEN 3 THEN 'Re: ' WHEN 4 THEN 'Undeliverable: '
WHEN 5 THEN 'Automatic reply: ' WHEN 6 THEN 'Fwd:  ' ELSE 'Hello ' END, coalesce(source, 'someone'), ' about ', cast(n_chars as string), ' things in ', coalesce(lang, 'any'))"""
SENDER = "concat('User ', cast(doc_id % 50 as string), ' <User', cast(doc_id % 50 as string), '@Mail', cast(doc_id % 9 as string), '.Example.COM>')"
PATH = "concat('/box/', CASE doc_id % 4 WHEN 0 THEN 'spam' WHEN 1 THEN 'easy_ham' WHEN 2 THEN 'hard_ham' ELSE 'other' END, '/', lpad(cast(doc_id % 300 as string), 5, '0'), '.', md5(text))"
BOX = "concat('/mail/', CASE doc_id % 4 WHEN 0 THEN 'phishing' WHEN 1 THEN 'private-phishing4' WHEN 2 THEN 'a-b' ELSE 'phishing' END, CASE WHEN doc_id % 4 = 1 THEN '' ELSE concat('-', cast(2015 + doc_id % 10 as string)) END, '.mbox')"
LABEL = "cast(coalesce(toxic, doc_id % 2) as int)"
COHORT = f"({LABEL} + 2 * (cast(substr(source, 4) as int) % 2))"
WEIGHT = "((doc_id * 37 + {k} * 11) % 10 + 1 + CASE WHEN cohort = {k} AND doc_id % 3 > 0 THEN 6 ELSE 0 END)"


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, subject, body, label, cohort, sender, path, box."""
    docs = table(spark, sf_dir, "documents")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    body = BODY.replace("\\u200b", "\u200b").replace("\\u00a0", "\u00a0")
    d = docs.join(labels, "doc_id", "left")
    return d.selectExpr("doc_id", "lang", "source", f"{SUBJECT} as subject", f"{body} as body", f"{LABEL} as label", f"{COHORT} as cohort", f"{SENDER} as sender", f"{PATH} as path", f"{BOX} as box")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, subject, body, sender, path, box: what needs no label, from one scan."""
    body = BODY.replace("\\u200b", "\u200b").replace("\\u00a0", "\u00a0")
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr("doc_id", "lang", "source", f"{SUBJECT} as subject", f"{body} as body", f"{SENDER} as sender", f"{PATH} as path", f"{BOX} as box")


def labelled(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with doc_id and their label."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.join(labels, "doc_id", "left").withColumn("label", F.expr(LABEL)).drop("toxic")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y_true, y_pred, p0..p3, latency_ms."""
    e = emails(spark, sf_dir).select("doc_id", "cohort")
    w = e.selectExpr("*", *(f"{WEIGHT.format(k=k)} as w{k}" for k in range(4)))
    total = "(w0 + w1 + w2 + w3)"
    return w.selectExpr("doc_id", "cast(cohort as int) as y_true", "cast(CASE WHEN doc_id % 7 = 0 THEN (cohort + 1) % 4 ELSE cohort END as int) as y_pred", *(f"cast(w{k} as double) / {total} as p{k}" for k in range(4)), "cast(doc_id % 23 as double) / 4 as latency_ms")


def _duck(s: str) -> str:
    return s.replace("as string)", "as varchar)").replace("\\u200b", "\u200b").replace("\\u00a0", "\u00a0")


EMAILS_SQL = _duck(f"""WITH emails AS (
SELECT doc_id, lang, source, {SUBJECT} AS subject, {BODY} AS body, {LABEL} AS label, {COHORT} AS cohort, {SENDER} AS sender, {PATH} AS path, {BOX} AS box
FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))
""")
PREDICTIONS_SQL = EMAILS_SQL + ", weights AS (SELECT *, " + ", ".join(f"{WEIGHT.format(k=k)} AS w{k}" for k in range(4)) + """ FROM emails),
predictions AS (SELECT doc_id, cohort AS y_true, CASE WHEN doc_id % 7 = 0 THEN (cohort + 1) % 4 ELSE cohort END AS y_pred,
""" + ", ".join(f"CAST(w{k} AS DOUBLE) / (w0 + w1 + w2 + w3) AS p{k}" for k in range(4)) + ", CAST(doc_id % 23 AS DOUBLE) / 4 AS latency_ms FROM weights)\n"

"""One query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailloom.functions import features as fx
from mailloom.functions import gazetteer
from mailloom.functions import lookalikes as la
from mailloom.functions import masking as mk
from mailloom.functions import text as tx
from mailloom.operators import dedup, heads, intervals, language, latent, metrics, portable, records, sampling, semantic, tfidf
from mailloom.operators.ranking import ranked
from mailloom.sources import html as hx
from mailloom.sources import mail, parts, runs
from mailloom.sources.shared import new_path, stored
from mailloom.sources.tables import table
from mailloom.streaming import ingest, keyed

from . import flows
from .fixtures import EMAILS_SQL, PREDICTIONS_SQL, bodies, emails, labelled, predictions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (ctes + sql).strip()
        return f

    return keep


E, P = EMAILS_SQL, PREDICTIONS_SQL
_STRIP = r"regexp_replace({}, '\A\s+|\s+\z', '', 'g')"
_any = "|".join
_q = lambda s: s.replace("'", "''")
SLICE_SQL = _STRIP.format(f"regexp_split_to_array(body, '{_any(tx.THREAD_STARTS)}')[1]")
HTML_SQL = "(contains({c}, '</') OR " + " OR ".join(f"contains(lower({{c}}), '{m}')" for m in tx.HTML_MARKERS) + ")"


def mask_sql(c: str, name: str) -> str:
    """A rule for an engine without lookaround."""
    _, flags, body, token = mk.RULES[mk.NAMES.index(name)]
    rewritten = {
        "url": (r"((?:https?://|ftp://|www\.)[^\s<>\"'\\]*[^\s<>\"'\\.,;:!?)\]}])", token),
        "bare_url": (r"(^|[^\w@])" + body.removeprefix(r"(?<![\w@])").replace(r"(?:/[^\s<>\"'\\]*)(?<![.,;:!?)\]}])", r"/(?:[^\s<>\"'\\]*[^\s<>\"'\\.,;:!?)\]}])?"), r"\1" + token),
        "phone": (r"(^|[^\d])" + body.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)") + r"($|[^\d])", r"\1" + token + r"\2"),
        "unix_path": (r"(^|[^\w])" + body.removeprefix(r"(?<!\w)"), r"\1" + token),
        "reference": (body.removeprefix("(?:").removesuffix(")").replace(r"(?=[\w\-]*\d[\w\-]*)", r"([\w\-]*\d[\w\-]*)").replace("(?<![A-Za-z0-9])", "(^|[^A-Za-z0-9])"), r"\2" + token + r"\1"),
    }
    body, token = rewritten.get(name, (body, token))
    literal = "'" + _q(token).replace("\n", "' || chr(10) || '") + "'"
    prefix = f"(?{flags})" if flags else ""
    return f"regexp_replace({c}, '{prefix}{_q(body)}', {literal}, 'g')"


# ---- flagship -------------------------------------------------------------------

def _chain_sql(c: str) -> str:
    for name in mk.NAMES:
        c = mask_sql(c, name)
    return c


@query("clean_corpus_counts", f""", s AS (SELECT doc_id, source, label, subject, {SLICE_SQL} AS body FROM emails WHERE length(body) >= 50),
d AS (SELECT *, row_number() OVER (PARTITION BY source, md5(concat(subject, body)) ORDER BY doc_id) AS k FROM s WHERE length(body) >= 50),
m AS (SELECT label, source, {_chain_sql('body')} AS body FROM d WHERE k = 1)
SELECT label, source, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM m GROUP BY label, source""", E)
def clean_corpus_counts(spark, d):
    """Cleaned, deduplicated and masked. All that is made of a body is made at once, while it is scanned: only fingerprints and lengths move. Short bodies have no fingerprint and go last, as a filter on what is made would make it twice."""

    def made(b):
        return F.when(tx.long_enough(b), F.struct(fx.fingerprint(F.col("subject"), b).alias("fp"), F.length(mk.mask(b, unicode=False)).alias("chars")))

    sliced = F.when(tx.long_enough(F.col("body")), tx.slice_thread(F.col("body"), unicode=False))
    rows = bodies(spark, d).select("doc_id", "source", F.transform(F.array(sliced), made)[0].alias("m")).select("doc_id", "source", "m.fp", "m.chars")
    one = dedup.first_of_each(rows, ["source", "fp"], ["doc_id"]).filter("chars is not null")
    return labelled(one, spark, d).groupBy("label", "source").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


# ---- cleaning --------------------------------------------------------------------


@query("clean_slice", f"SELECT doc_id, {SLICE_SQL} AS body FROM emails", E)
def clean_slice(spark, d):
    return bodies(spark, d).select("doc_id", tx.slice_thread(F.col("body"), unicode=False).alias("body"))


@query("slice_pattern_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS pattern, count(*) FILTER (WHERE regexp_matches(body, '{p}')) AS n FROM emails" for k, p in enumerate(tx.THREAD_STARTS)) + ")", E)
def slice_pattern_counts(spark, d):
    one = bodies(spark, d).agg(*(F.count_if(F.col("body").rlike("(?d)" + p)).alias(f"c{k}") for k, p in enumerate(tx.THREAD_STARTS)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(f"c{k}").alias("n")) for k in range(len(tx.THREAD_STARTS))))))


@query("is_html_pages", f"SELECT page_id, {HTML_SQL.format(c='html')} AS is_html FROM pages")
def is_html_pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.is_html(F.col("html")).alias("is_html"))


@query("is_html_emails", f"SELECT doc_id, {HTML_SQL.format(c='body')} AS is_html FROM emails", E)
def is_html_emails(spark, d):
    return bodies(spark, d).select("doc_id", tx.is_html(F.col("body")).alias("is_html"))


def _entities(c: str) -> str:
    for entity, char in hx.ENTITIES:
        c = f"replace({c}, '{entity}', '{_q(char)}')"
    return c


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n|[\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '(?m)[^\S\n]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\s+|\s+\z', '', 'g')"
_TAGS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', chr(10), 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', chr(10), 'g'), '(?is)<head\b[^>]*>.*?</head\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g')"


@query("html_text_pages", "SELECT page_id, " + _NORMAL.format(_entities(_TAGS)) + " AS body FROM pages")
def html_text_pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", hx.clean_native(F.col("html"), unicode=False).alias("body"))


_PIECES = r"regexp_replace(html, '(?is)(?:<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<head\b[^>]*>.*?</head\s*>|<!--.*?-->|<[^>]*>)+', chr(10), 'g')"


@query("html_text_parsed", "SELECT page_id, " + _NORMAL.format(_entities(_PIECES)) + " AS body FROM pages")
def html_text_parsed(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", hx.clean_payload_known("html").alias("body"))


@query("norm_whitespace", "SELECT doc_id, " + _NORMAL.format("body") + " AS body FROM emails", E)
def norm_whitespace(spark, d):
    return bodies(spark, d).select("doc_id", tx.normalise_space(F.col("body"), unicode=False).alias("body"))


def _lookalike_sql(c: str) -> str:
    table = la.lookalikes()
    single = {k: v for k, v in table.items() if len(v) == 1}
    c = f"translate({c}, '{''.join(single)}', '{''.join(single.values())}')"
    for k, v in table.items():
        if len(v) > 1:
            c = f"replace({c}, '{k}', '{v}')"
    return c


@query("homoglyph_map", "SELECT doc_id, " + _lookalike_sql("body") + " AS body FROM emails", E)
def homoglyph_map(spark, d):
    return bodies(spark, d).select("doc_id", la.replace_lookalikes(F.col("body")).alias("body"))


@query("drop_invisible", r"SELECT doc_id, regexp_replace(body, '\p{Cf}', '', 'g') AS body FROM emails", E)
def drop_invisible(spark, d):
    return bodies(spark, d).select("doc_id", la.drop_invisible(F.col("body")).alias("body"))


# the other engine composes only canonically; of compatibility forms the messages have the hard blank
@query("unicode_normal", "SELECT doc_id, " + _lookalike_sql(r"regexp_replace(replace(nfc_normalize(body), chr(160), ' '), '\p{Cf}', '', 'g')") + " AS body FROM emails", E)
def unicode_normal(spark, d):
    return bodies(spark, d).select("doc_id", la.normalise_unicode("body").alias("body"))


@query("strip_from_line", r"SELECT doc_id, regexp_replace('From ' || source || chr(10) || body, '\AFrom [^\n]*\n', '') AS body FROM emails", E)
def strip_from_line(spark, d):
    return bodies(spark, d).select("doc_id", tx.strip_from_line(F.concat(F.lit("From "), "source", F.lit("\n"), "body")).alias("body"))


@query("header_one_line", r"SELECT doc_id, " + _STRIP.format(r"regexp_replace(subject || chr(13) || chr(10) || chr(9) || source, '\s+', ' ', 'g')") + " AS subject FROM emails", E)
def header_one_line(spark, d):
    return bodies(spark, d).select("doc_id", tx.one_line(F.concat("subject", F.lit("\r\n\t"), "source")).alias("subject"))


@query("format_text", "SELECT doc_id, 'Subject: ' || " + _STRIP.format("subject") + " || '. Body: ' || " + _STRIP.format("body") + " AS text FROM emails", E)
def format_text(spark, d):
    return bodies(spark, d).select("doc_id", tx.classifier_text(F.col("subject"), F.col("body"), unicode=False).alias("text"))


@query("preview", "SELECT doc_id, CASE WHEN length(body) > 300 THEN left(body, 300) || '...' ELSE body END AS preview FROM emails", E)
def preview(spark, d):
    return bodies(spark, d).select("doc_id", tx.preview(F.col("body")).alias("preview"))


@query("seed_blocks", ", r AS (SELECT (row_number() OVER (ORDER BY doc_id)) - 1 AS n, * FROM emails) SELECT CAST(n // 10 AS BIGINT) AS batch, string_agg('--- Email ' || CAST(n % 10 + 1 AS VARCHAR) || ' ---' || chr(10) || 'Subject: ' || " + _STRIP.format("subject") + " || chr(10) || chr(10) || substr(" + _STRIP.format("body") + ", 1, 1500), chr(10) || chr(10) ORDER BY n) AS prompt FROM r GROUP BY n // 10", E)
def seed_blocks(spark, d):
    rows = _numbered(bodies(spark, d), "doc_id")
    return sampling.seed_blocks(rows, 10)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    """Rows with their place n, from 0, in the order of an integer key."""
    return ranked(df, [], F.floor(F.col(key) / 4096), [key]).withColumn("n", F.col("__n") - 1).drop("__n", "__total")


# ---- filters ----------------------------------------------------------------------


@query("ndr_filter", f"SELECT doc_id, subject FROM emails WHERE NOT regexp_matches(subject, '(?i){_any(tx.BOUNCE_SUBJECTS)}')", E)
def ndr_filter(spark, d):
    return bodies(spark, d).filter(~tx.is_bounce(F.col("subject"))).select("doc_id", "subject")


@query("system_body_filter", f"SELECT doc_id FROM emails WHERE NOT regexp_matches(body, '(?im){_any(tx.SYSTEM_BODIES)}')", E)
def system_body_filter(spark, d):
    return bodies(spark, d).filter(~tx.is_system_body(F.col("body"))).select("doc_id")


@query("min_length", "SELECT doc_id, length(body) AS n FROM emails WHERE length(body) >= 50", E)
def min_length(spark, d):
    return bodies(spark, d).filter(tx.long_enough(F.col("body"))).select("doc_id", F.length("body").alias("n"))


@query("empty_body_filter", "SELECT doc_id FROM emails WHERE " + SLICE_SQL + " <> ''", E)
def empty_body_filter(spark, d):
    return bodies(spark, d).filter(tx.slice_thread(F.col("body"), unicode=False) != "").select("doc_id")


@query("language_filter", "SELECT doc_id, lang FROM documents WHERE coalesce(lang, '') = 'en'")
def language_filter(spark, d):
    return records.in_language(spark.read.parquet(f"{d}/documents.parquet"), "en", "lang").select("doc_id", "lang")


@query("model_filter", "SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src3', 'src5') GROUP BY source")
def model_filter(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").filter(F.col("source").isin("src1", "src3", "src5")).groupBy("source").agg(F.count("*").alias("n"))


@query("filter_eq", "SELECT doc_id FROM documents WHERE lang IS NOT DISTINCT FROM 'fr' AND source IS NOT DISTINCT FROM 'src3'")
def filter_eq(spark, d):
    return records.equal_to(spark.read.parquet(f"{d}/documents.parquet"), lang="fr", source="src3").select("doc_id")


# ---- features ---------------------------------------------------------------------

_URLS = f"list_sort(list_distinct([regexp_replace(u, '[.,;)>''\"\\]]+\\z', '') FOR u IN regexp_extract_all(body, '(?i){fx.URL}')]))"
_URLS = f"[u FOR u IN {_URLS} IF u <> '']"
_HOST = r"lower(regexp_extract(u, '^(?:https?://)?(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_DEPTH = f"CASE WHEN regexp_matches(replace({_HOST}, '.', ''), '^[0-9]*$') THEN 0 ELSE greatest(len(string_split({_HOST}, '.')) - 2, 0) END"


@query("url_extract", f"SELECT doc_id, {_URLS} AS urls FROM emails", E)
def url_extract(spark, d):
    return bodies(spark, d).select("doc_id", fx.urls(F.col("body")).alias("urls"))


@query("url_metrics", f", u AS (SELECT doc_id, {_URLS} AS us FROM emails) SELECT doc_id, CAST(len(us) AS INT) AS url_count, CAST(coalesce(list_max([length(u) FOR u IN us]), 0) AS INT) AS url_length_max, coalesce(round(list_avg([length(u) FOR u IN us]), 2), 0.0) AS url_length_avg, CAST(coalesce(list_max([{_DEPTH} FOR u IN us]), 0) AS INT) AS url_subdom_max, coalesce(round(list_avg([{_DEPTH} FOR u IN us]), 2), 0.0) AS url_subdom_avg FROM u", E)
def url_metrics(spark, d):
    e = bodies(spark, d).select("doc_id", fx.urls(F.col("body")).alias("us"))
    return e.select("doc_id", *(c.alias(k) for k, c in fx.url_metrics(F.col("us")).items()))


@query("subdomain_counts", f"SELECT page_id, CAST({_DEPTH.replace('(u,', '(url,')} AS INT) AS n FROM pages")
def subdomain_counts(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", fx.subdomains(F.col("url")).alias("n"))


@query("sender_hash_domain", "SELECT doc_id, sha256(lower(regexp_extract(sender, '<([^<>]*)>', 1))) AS sender, string_split(lower(regexp_extract(sender, '<([^<>]*)>', 1)), '@')[2] AS sender_domain FROM emails", E)
def sender_hash_domain(spark, d):
    return bodies(spark, d).select("doc_id", fx.address_hash(F.col("sender")).alias("sender"), fx.address_domain(F.col("sender")).alias("sender_domain"))


@query("body_choice", "SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE body END, ''), subject) AS body FROM emails", E)
def body_choice(spark, d):
    plain = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("body"))
    return bodies(spark, d).select("doc_id", F.coalesce(F.nullif(plain, F.lit("")), "subject").alias("body"))


def _language_sql() -> str:
    s = _STRIP.format("body")
    counts = [f"len([w FOR w IN ws IF w IN ({', '.join(repr(w) for w in stop)})])" for stop in fx.STOP_WORDS.values()]
    rows = f", w AS (SELECT doc_id, length({s}) AS n, regexp_split_to_array(lower(substr({s}, 1, 1000)), '\\s+') AS ws FROM emails), c AS (SELECT doc_id, n, {', '.join(f'{c} AS c{k}' for k, c in enumerate(counts))} FROM w)"
    best = "greatest(c0, c1, c2, c3)"
    pick = " ".join(f"WHEN c{k} = {best} THEN '{lang}'" for k, lang in enumerate(fx.STOP_WORDS))
    return f"{rows} SELECT doc_id, CASE WHEN n < 15 THEN 'unknown' WHEN {best} = 0 THEN 'en' {pick} END AS language FROM c"


@query("detect_language", _language_sql(), E)
def detect_language(spark, d):
    return bodies(spark, d).select("doc_id", fx.language_native(F.col("body")).alias("language"))


_LANG_GRAMS = r"""WITH t AS (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '\A\s+|\s+\z', '', 'g') AS s FROM documents),
p AS (SELECT doc_id, lang, length(s) AS len, ' ' || regexp_replace(lower(substr(s, 1, 1000)), '\s+', ' ', 'g') || ' ' AS s FROM t),
g AS (SELECT doc_id, lang, unnest([substr(s, i, 3) FOR i IN range(1, greatest(length(s) - 2, 1) + 1)]) AS gram FROM p WHERE len >= 15 OR (lang IS NOT NULL AND doc_id % 3 <> 1)),
c AS (SELECT lang, gram, count(*) AS c FROM g WHERE lang IS NOT NULL AND doc_id % 3 <> 1 GROUP BY lang, gram),
k AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(c) DESC, gram LIMIT 50000),
ck AS (SELECT * FROM c JOIN k USING (gram)),
n AS (SELECT lang, sum(c) AS total, (SELECT count(DISTINCT gram) FROM ck) AS v FROM ck GROUP BY lang),
u AS (SELECT lang, CAST(round(ln(1.0 / CAST(total + v + 1 AS DOUBLE)) * 1048576) AS BIGINT) AS u FROM n),
w AS (SELECT lang, gram, CAST(round(ln(CAST(c + 1 AS DOUBLE) / CAST(total + v + 1 AS DOUBLE)) * 1048576) AS BIGINT) AS w FROM ck JOIN n USING (lang)),
d AS (SELECT g.doc_id, u.lang, sum(coalesce(w.w, u.u)) AS s FROM g JOIN p USING (doc_id) CROSS JOIN u LEFT JOIN w ON w.lang = u.lang AND w.gram = g.gram WHERE p.len >= 15 GROUP BY g.doc_id, u.lang),
b AS (SELECT doc_id, lang AS language FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) AS r FROM d) WHERE r = 1)
SELECT doc_id, coalesce(language, 'unknown') AS language FROM p LEFT JOIN b USING (doc_id)"""


@query("language_ngrams", _LANG_GRAMS)
def language_ngrams(spark, d):
    """Every text's language by a model of the rows that a third of the ids, which are judged only, are not among."""
    docs = table(spark, d, "documents")
    return language.detect(docs, language.fit(docs.filter("doc_id % 3 <> 1")))


@query("gazetteer_counts", r"""WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM benchmark),
n AS (SELECT w, CASE length(w) % 3 WHEN 0 THEN 'GPE' WHEN 1 THEN 'ORG' ELSE 'PERSON' END AS label FROM b WHERE regexp_full_match(w, '[A-Z][a-z]{3,}')),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)
SELECT doc_id, label, count(*) AS n FROM t JOIN n USING (w) GROUP BY doc_id, label""")
def gazetteer_counts(spark, d):
    """Names are the capitalised words of the benchmark's items; how many of each label every text has."""
    words = spark.read.parquet(f"{d}/benchmark.parquet").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name")).distinct()
    label = F.when(F.length("name") % 3 == 0, "GPE").when(F.length("name") % 3 == 1, "ORG").otherwise("PERSON")
    names = words.filter(F.col("name").rlike("^[A-Z][a-z]{3,}$")).withColumn("label", label)
    return gazetteer.entities(table(spark, d, "documents"), gazetteer.Tagger(names)).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


_SPANS = "SELECT event_id, user_id, CAST(epoch_us(ts) AS BIGINT) AS a, CAST(epoch_us(ts) + floor(value * 60000000) + 1 AS BIGINT) AS b FROM events WHERE event_type {} 'error' AND value >= 0"


@query("interval_overlap", f"WITH l AS ({_SPANS.format('=')}), r AS ({_SPANS.format('<>')}) SELECT l.event_id, r.event_id AS other_id, CAST(least(l.b, r.b) - greatest(l.a, r.a) AS BIGINT) AS shared FROM l JOIN r ON l.user_id = r.user_id AND l.a < r.b AND r.a < l.b")
def interval_overlap(spark, d):
    """Errors and other events of a user whose times, as long as their values in minutes, overlap."""
    ev = spark.read.parquet(f"{d}/events.parquet").filter("value >= 0")
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    finish = begin + F.floor(F.col("value") * 60_000_000) + 1
    l = ev.filter("event_type = 'error'").select("event_id", "user_id", begin.alias("a"), finish.alias("b"))  # noqa: E741
    r = ev.filter("event_type <> 'error'").select(F.col("event_id").alias("other_id"), "user_id", begin.alias("c"), finish.alias("e"))
    return intervals.overlapping(l, r, ["user_id"], "a", "b", "c", "e").select("event_id", "other_id", (F.least("b", "e") - F.greatest("a", "c")).alias("shared"))


@query("fingerprints", "SELECT doc_id, md5(concat(subject, body)) AS fp FROM emails", E)
def fingerprints(spark, d):
    return bodies(spark, d).select("doc_id", fx.fingerprint(F.col("subject"), F.col("body")).alias("fp"))


@query("model_hash", "SELECT source, CAST(CAST('0x' || md5(source) AS UHUGEINT) % 10000 AS INT) AS h FROM (SELECT DISTINCT source FROM documents)")
def model_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("source").distinct().select("source", fx.model_hash_column(F.col("source")).alias("h"))


# ---- duplicates and sources ---------------------------------------------------------


@query("fingerprint_dedup", "SELECT source, min_id AS doc_id FROM (SELECT source, min(doc_id) AS min_id FROM documents GROUP BY source, md5(concat(coalesce(lang, ''), text)))")
def fingerprint_dedup(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return dedup.by_fingerprint(docs, "lang", "text").select("source", "doc_id")


@query("filename_dedup_md5", "SELECT min(path) AS path FROM emails GROUP BY string_split(path, '.')[-1]", E)
def filename_dedup_md5(spark, d):
    return dedup.by_file_name(bodies(spark, d).select("path")).select("path")


@query("filename_dedup_stem", "SELECT min(path) AS path FROM emails GROUP BY regexp_extract(path, '([^/]*)[.][^./]*$', 1)", E)
def filename_dedup_stem(spark, d):
    return dedup.by_file_name(bodies(spark, d).select("path"), key="stem").select("path")


@query("folder_labels", "SELECT doc_id, CASE string_split(path, '/')[3] WHEN 'spam' THEN 1 ELSE 0 END AS label FROM emails WHERE string_split(path, '/')[3] IN ('spam', 'easy_ham', 'hard_ham')", E)
def folder_labels(spark, d):
    return bodies(spark, d).select("doc_id", mail.folder_label(F.col("path")).alias("label")).filter("label is not null")


@query("year_prune", r"SELECT box, count(*) AS n FROM emails WHERE coalesce(TRY_CAST(regexp_extract(string_split(box, '/')[-1], '^[^-]*-(\d{4})\.mbox$', 1) AS INT), 0) <= 2022 GROUP BY box", E)
def year_prune(spark, d):
    year = mail.year_of_file(F.col("box"))
    return bodies(spark, d).filter(year.isNull() | (year <= 2022)).groupBy("box").agg(F.count("*").alias("n"))


@query("mailbox_round_trip", "SELECT doc_id, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS digest, (SELECT count(*) FROM documents) AS messages FROM documents")
def mailbox_round_trip(spark, d):
    """Documents written as mailbox files and read back in splits: every text as it was, and as many messages as the files' last numbers say."""
    docs = table(spark, d, "documents")
    path = new_path(spark, "mailbox")
    message = F.concat(F.lit("X-Id: "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    mail.write_mbox(docs.select(message.alias("raw")), path)
    found = mail.mbox(spark, path, glob="*.txt").select("path", "ordinal", mail.unquoted(F.col("raw")).alias("raw"))
    total = found.groupBy("path").agg((F.max("ordinal") + 1).alias("k")).agg(F.sum("k").alias("messages"))
    head = F.substring_index("raw", "\n\n", 1)
    body = F.expr("substring(raw, length(substring_index(raw, '\n\n', 1)) + 3)")
    text = F.regexp_replace(body, r"\n\z", "")
    rows = found.select(F.regexp_extract(head, r"X-Id: (\d+)", 1).cast("long").alias("doc_id"), F.length(text).alias("n"), F.md5(text).alias("digest"))
    return rows.crossJoin(F.broadcast(total))


_INDEX = ", idx AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'spam' WHEN 1 THEN 'HAM' WHEN 2 THEN 'ham' WHEN 3 THEN 'Spam' ELSE 'junk' END || ' ../data/inmail.' || CAST(doc_id AS VARCHAR) AS value FROM emails), lines AS (SELECT lower(string_split(value, ' ')[1]) AS w, string_split(value, '/')[-1] AS name FROM idx WHERE lower(string_split(value, ' ')[1]) IN ('spam', 'ham')), files AS (SELECT doc_id, 'inmail.' || CAST(doc_id AS VARCHAR) AS name FROM emails) "


def _index(spark, d):
    e = bodies(spark, d)
    word = F.when(F.col("doc_id") % 5 == 0, "spam").when(F.col("doc_id") % 5 == 1, "HAM").when(F.col("doc_id") % 5 == 2, "ham").when(F.col("doc_id") % 5 == 3, "Spam").otherwise("junk")
    ok, label, name = mail.index_rows(F.concat(word, F.lit(" ../data/inmail."), F.col("doc_id").cast("string")))
    return e.filter(ok).select(name.alias("name"), label.alias("label")), e.select("doc_id", F.concat(F.lit("inmail."), F.col("doc_id").cast("string")).alias("name"))


@query("index_join", _INDEX + "SELECT doc_id, CASE w WHEN 'spam' THEN 1 ELSE 0 END AS label FROM files JOIN lines USING (name)", E)
def index_join(spark, d):
    idx, files = _index(spark, d)
    return files.join(idx, "name").select("doc_id", "label")


@query("index_anti", _INDEX + "SELECT count(*) AS skipped_no_label FROM files WHERE name NOT IN (SELECT name FROM lines)", E)
def index_anti(spark, d):
    idx, files = _index(spark, d)
    return files.join(idx, "name", "left_anti").agg(F.count("*").alias("skipped_no_label"))


@query("mime_round_trip", r"SELECT doc_id, trim(regexp_replace(subject, '\s+', ' ', 'g')) AS subject, regexp_replace(regexp_replace(body, '\r\n?', chr(10), 'g'), '([^\n])\z', '\1' || chr(10)) AS body FROM emails", E)
def mime_round_trip(spark, d):
    e = bodies(spark, d).select("doc_id", mail.mime_message(F.col("doc_id").cast("string"), "subject", "body").alias("raw"))
    return e.select("doc_id", mail.read_message("raw").alias("m")).select("doc_id", "m.subject", "m.body")


# a part that is coded is decoded whole; in a part that is not, the parser drops Latin-1 letters and escapes others
_PLAIN = r"regexp_replace(regexp_replace(body, '\r\n?', chr(10), 'g'), '([^\n])\z', '\1' || chr(10))"
_MIME = r""", l AS (SELECT doc_id, trim(regexp_replace(subject, '\s+', ' ', 'g')) AS subject, """ + _PLAIN + r""" AS body FROM emails),
m AS (SELECT *, list_max([strlen(x) FOR x IN string_split(body, chr(10))]) > 78 AS coded FROM l)
SELECT doc_id, subject, 'user@example.com' AS sender, 'Thu, 10 Sep 2026 12:00:00 +0000' AS date, ['text/plain'] AS content_types, 0 AS attachment_count, NULL::VARCHAR AS parse_error,
CASE WHEN coded THEN body ELSE array_to_string([CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) < 256 THEN '' WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c)) ELSE printf('\U%08x', unicode(c)) END FOR c IN string_split(body, '')], '') END AS plain FROM m"""


@query("mime_parse", _MIME, E)
def mime_parse(spark, d):
    e = bodies(spark, d).select("doc_id", mail.mime_message(F.col("doc_id").cast("string"), "subject", "body").alias("raw"))
    return mail.parsed(e).select("doc_id", "subject", "sender", "date", "plain", "content_types", "attachment_count", "parse_error")


def _letter(c: str, kind: str, extra: str = "") -> str:
    return f"'--=-x\\nContent-Type: {kind}\\nContent-Transfer-Encoding: base64\\n{extra}\\n', base64(encode({c}, 'UTF-8')), '\\n'"


@query("mime_parts", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS id FROM documents), p AS (
SELECT doc_id, 0 AS part, 2 AS depth, 'text/plain' AS content_type, NULL AS file_name, false AS is_attachment, text AS content FROM d UNION ALL
SELECT doc_id, 1, 2, 'text/html', NULL, false, concat('<p>', text, '</p>') FROM d UNION ALL
SELECT doc_id, 2, 1, 'application/json', concat(id, '.json'), true, concat('{"id": ', id, '}') FROM d)
SELECT doc_id, part, depth, content_type, file_name, is_attachment, strlen(content) AS size, md5(content) AS digest FROM p""")
def mime_parts(spark, d):
    """Each document as a message of a text in two forms and an attachment; its parts by the table function beside the table."""
    inner = "Content-Type: multipart/alternative; boundary=\"=-y\"\\n\\n"
    two = [_letter("coalesce(text, '')", "text/plain; charset=utf-8"), _letter("concat('<p>', coalesce(text, ''), '</p>')", "text/html; charset=utf-8")]
    two = [x.replace("--=-x", "--=-y") for x in two]
    file = _letter("""concat('{"id": ', doc_id, '}')""", "application/json", "Content-Disposition: attachment; filename=\"@.json\"\\n").replace("@", "', doc_id, '")
    raw = f"concat('Subject: s\\nMIME-Version: 1.0\\nContent-Type: multipart/mixed; boundary=\"=-x\"\\n\\n--=-x\\n{inner}', {two[0]}, {two[1]}, '--=-y--\\n', {file}, '--=-x--\\n')"
    parts.register(spark)
    mails = table(spark, d, "documents").selectExpr("doc_id", f"{raw} AS raw")
    return spark.sql("SELECT doc_id, part, depth, content_type, file_name, is_attachment, size, md5(content) AS digest FROM {mails}, LATERAL mail_parts(raw, body => 'bytes')", mails=mails)


@query("json_input", "SELECT doc_id, body FROM emails WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, body FROM emails WHERE doc_id % 2 = 1", E)
def json_input(spark, d):
    e = bodies(spark, d).withColumn("line", F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("body"))).otherwise(F.col("body")))
    rec = F.from_json("line", "body string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    return e.select("doc_id", F.coalesce(F.when(F.trim("line").startswith("{"), rec["body"]), "line").alias("body"))


# ---- masking -------------------------------------------------------------------------

for _name in mk.NAMES:
    query(f"mask_{_name}", f"SELECT doc_id, {mask_sql('body', _name)} AS body FROM emails", E)(lambda spark, d, name=_name: bodies(spark, d).select("doc_id", mk.mask_one(F.col("body"), name, unicode=False).alias("body")))


@query("mask_chain", f"SELECT doc_id, {_chain_sql('subject')} AS subject, {_chain_sql('body')} AS body FROM emails", E)
def mask_chain(spark, d):
    return bodies(spark, d).select("doc_id", mk.mask(F.col("subject"), unicode=False).alias("subject"), mk.mask(F.col("body"), unicode=False).alias("body"))


@query("mask_token_histogram", f", m AS (SELECT {_chain_sql('body')} AS body FROM emails) SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(body, '{mk.TOKEN}')) AS token FROM m) GROUP BY token", E)
def mask_token_histogram(spark, d):
    m = bodies(spark, d).select(mk.mask(F.col("body"), unicode=False).alias("body"))
    return m.select(F.explode(F.regexp_extract_all("body", F.lit(mk.TOKEN), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("mask_entities", r"SELECT doc_id, subject, regexp_replace(body, '(^|[^\w\p{L}\p{N}])(The\s+)[\w\p{L}\p{N}]+', '\1\2[NAME]', 'g') AS body FROM emails", E)
def mask_entities(spark, d):
    """A stand-in tagger marks the words after ``The`` as persons."""

    def tagger(texts):
        import re

        return [[(m.start(1), m.end(1), "PERSON") for m in re.finditer(r"\bThe\s+(\w+)", s)] for s in texts]

    run = mk.entity_masker(tagger)
    return bodies(spark, d).select("doc_id", run("subject", "body").alias("m")).select("doc_id", "m.subject", "m.body")


# ---- records, statistics ---------------------------------------------------------------


def _raw_records(spark, d):
    e = emails(spark, d)
    label = F.when(F.col("doc_id") % 11 == 0, 2).otherwise(F.col("label"))
    body = F.when(F.col("doc_id") % 13 == 0, "  \n ").otherwise(F.col("body"))
    source = F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("source"))
    return e.select("doc_id", "subject", body.alias("body"), label.alias("label"), source.alias("source"))


_RAW = ", raw AS (SELECT doc_id, subject, CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE body END AS body, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE label END AS label, CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS source FROM emails), v AS (SELECT *, label IN (0, 1) AND trim(source) <> '' AND regexp_matches(body, '\\S') AS ok FROM raw) "


@query("validate_counts", _RAW + "SELECT count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS invalid, count(*) AS total FROM v", E)
def validate_counts(spark, d):
    return records.validation_counts(_raw_records(spark, d))


@query("validate_filter", _RAW + "SELECT doc_id, label, source FROM v WHERE ok", E)
def validate_filter(spark, d):
    return _raw_records(spark, d).filter(records.is_valid()).select("doc_id", "label", "source")


@query("export_minimal", "SELECT subject, body, label, source FROM emails", E)
def export_minimal(spark, d):
    return records.exported(emails(spark, d), "minimal")


@query("export_custom", "SELECT doc_id, subject, label FROM emails", E)
def export_custom(spark, d):
    return records.exported(emails(spark, d), "custom", ("doc_id", "subject"))


@query("label_route_counts", "SELECT label, count(*) AS n FROM emails GROUP BY label", E)
def label_route_counts(spark, d):
    return emails(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query("stats_label", "SELECT label, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM emails) AS share FROM emails GROUP BY label ORDER BY label", E)
def stats_label(spark, d):
    by = emails(spark, d).groupBy("label").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).orderBy("label")


@query("stats_source", "SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source")
def stats_source(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "source")


@query("stats_grouping_sets", "SELECT label, source, count(*) AS n, CAST(grouping(label, source) AS BIGINT) AS level FROM emails GROUP BY GROUPING SETS ((label), (source), ())", E)
def stats_grouping_sets(spark, d):
    return records.label_source_counts(emails(spark, d))


_STATUS = ", s AS (SELECT source, CASE WHEN regexp_matches(subject, '(?i)" + _any(tx.BOUNCE_SUBJECTS) + "') THEN 'bounce' WHEN regexp_matches(body, '(?im)" + _any(tx.SYSTEM_BODIES) + "') THEN 'system' WHEN length(body) < 50 THEN 'short' ELSE 'kept' END AS status FROM emails) SELECT source, status, count(*) AS n FROM s GROUP BY source, status"


@query("pipeline_counters", _STATUS, E)
def pipeline_counters(spark, d):
    body = F.col("body")
    status = F.when(tx.is_bounce(F.col("subject")), "bounce").when(tx.is_system_body(body), "system").when(~tx.long_enough(body), "short").otherwise("kept")
    return records.status_counts(bodies(spark, d).withColumn("status", status))


@query("distinct_counts", "SELECT count(DISTINCT md5(text)) AS texts, count(DISTINCT source) AS sources, count(*) AS n FROM documents")
def distinct_counts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.agg(F.count_distinct(F.md5("text")).alias("texts"), F.count_distinct("source").alias("sources"), F.count("*").alias("n"))


@query("union_sources", "SELECT 'documents' AS part, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark' AS part, item_id AS id, text FROM benchmark")
def union_sources(spark, d):
    part = lambda t, key: spark.read.parquet(f"{d}/{t}.parquet").select(F.lit(t).alias("part"), F.col(key).alias("id"), "text")
    return part("documents", "doc_id").unionByName(part("benchmark", "item_id"))


# ---- sampling, provenance -------------------------------------------------------------------


@query("cohort_sample", ", r AS (SELECT doc_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM emails) SELECT doc_id, CAST(cohort AS BIGINT) AS cohort FROM r WHERE k <= 50", E)
def cohort_sample(spark, d):
    e = emails(spark, d).select("doc_id", F.col("cohort").cast("long").alias("cohort"))
    return sampling.sample_per_group(e, "cohort", 50)


@query("stratified_split", ", r AS (SELECT doc_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM emails) SELECT doc_id, CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r", E)
def stratified_split(spark, d):
    e = emails(spark, d).select("doc_id", "cohort")
    return sampling.stratified_split(e, "cohort").select("doc_id", "split")


@query("quotas", ", m AS (SELECT DISTINCT source AS model FROM documents), r AS (SELECT model, row_number() OVER (ORDER BY model) AS k, count(*) OVER () AS n FROM m) SELECT model, CAST(14007 // n + CASE WHEN k <= 14007 % n THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r", E)
def quotas(spark, d):
    return sampling.quota_column(14_007, spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("model")).distinct())


_MODELS = sampling.quotas(14_007, ["m-one", "m-two"])


def _seeds(spark, d):
    return _numbered(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source"), "doc_id").withColumnRenamed("n", "position").withColumnRenamed("source", "seed_source")


def _pool_sql() -> str:
    """The numbers that Python's generator draws, before they are scaled to the seeds that there are."""
    import random

    parts = []
    for m, quota in _MODELS.items():
        rng = random.Random(42 + fx.model_hash(m))
        drawn = [rng.random() for _ in range(int(quota * 1.5))]
        parts.append(f"SELECT '{m}' AS model, unnest({drawn!r}::DOUBLE[]) AS u, unnest(range({len(drawn)})) AS seed_idx")
    return ", u AS (" + " UNION ALL ".join(parts) + "), s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents), pool AS (SELECT model, CAST(seed_idx AS INT) AS seed_idx, doc_id FROM u JOIN s ON s.position = CAST(floor(u.u * s.n) AS BIGINT)) "


_POOL = _pool_sql().replace(", u AS", "WITH u AS", 1)


@query("seed_pool_lookup", _POOL + "SELECT model, seed_idx, doc_id FROM pool")
def seed_pool_lookup(spark, d):
    seeds = _seeds(spark, d)
    return sampling.seed_pool(spark, seeds, seeds.count(), _MODELS).select("model", "seed_idx", "doc_id")


@query("trace_join", _POOL + "SELECT model AS source, doc_id AS seed_doc_id FROM pool")
def trace_join(spark, d):
    seeds = _seeds(spark, d)
    pool = sampling.seed_pool(spark, seeds, seeds.count(), _MODELS)
    made = pool.select(F.col("model").alias("source"), "seed_idx")
    return sampling.trace(made, pool).select("source", F.col("doc_id").alias("seed_doc_id"))


@query("resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return sampling.not_done(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), spark.read.parquet(f"{d}/labels.parquet"), ["doc_id"])


@query("resume_positions", "SELECT source AS model, CAST((max(doc_id) // 10 + 1) * 10 AS BIGINT) AS position FROM documents GROUP BY source")
def resume_positions(spark, d):
    done = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("model"), F.col("doc_id").alias("seed_idx"))
    return sampling.resume_at(done, 10).select("model", F.col("position").cast("long").alias("position"))


@query("batch_atomic", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.doc_id // 10 = d.doc_id // 10 AND x.n_chars < 200)")
def batch_atomic(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("n_chars") >= 200).alias("is_valid"))
    return sampling.whole_batches(docs, 10, [], "doc_id").select("doc_id")


@query("published_runs", "SELECT doc_id, length(text) AS n, md5(text) AS digest, lang FROM documents")
def published_runs(spark, d):
    """Documents published in two runs, by whether they have a language. The first is written again with other rows, and a third one is never published: what is read has each document once, as it was written last."""
    docs, path = table(spark, d, "documents").select("doc_id", "text", "lang"), new_path(spark, "runs")
    known = docs.filter("lang is not null")
    runs.write_run(known.withColumn("text", F.upper("text")), path, "documents", "known")
    runs.write_run(docs.filter("lang is null"), path, "documents", "unknown")
    runs.stage(docs, path)
    runs.write_run(known, path, "documents", "known")
    return runs.read_runs(spark, path).select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"), "lang")


@query("batches_published", "SELECT doc_id FROM documents JOIN (SELECT doc_id // 10 AS b FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) = 10 AND min(CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END) = 1) ON doc_id // 10 = b")
def batches_published(spark, d):
    """Batches of ten documents whose rows come in several micro-batches, published once they are whole and all long enough."""
    docs, path = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("n_chars") >= 200).alias("is_valid")), new_path(spark, "batches")
    docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(3))).repartition(3, "part").write.partitionBy("part").parquet(f"{path}/in")
    rows = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.published_batches(rows, f"{path}/out", f"{path}/checkpoint", 10, (), "doc_id").awaitTermination()
    return runs.read_runs(spark, f"{path}/out")


@query("split_lookup_join", ", r AS (SELECT doc_id, cohort, row_number() OVER (PARTITION BY cohort ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM emails) SELECT r.doc_id, e.label, e.source FROM r JOIN emails e ON e.doc_id = r.doc_id WHERE r.i >= floor(r.n * 0.8) + floor(r.n * 0.1)", E)
def split_lookup_join(spark, d):
    """The test split's unmasked rows, by id."""
    e = emails(spark, d)
    test = sampling.stratified_split(e.select("doc_id", "cohort"), "cohort").filter("split = 'test'").select("doc_id")
    return test.join(e.select("doc_id", "label", "source"), "doc_id")


@query("first_n", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_n(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id").orderBy("doc_id").limit(100)


# ---- terms -------------------------------------------------------------------------------------

_ASCII_WORD = "[A-Za-z0-9_]+"
_TEXT = "'Subject: ' || " + _STRIP.format("subject") + " || '. Body: ' || " + _STRIP.format("body")
_WORDS = f", w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '{_ASCII_WORD}') AS ws FROM emails), g AS (SELECT doc_id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY doc_id, term) "


def _texts(spark, d):
    """doc_id, text: what a classifier reads, subject and whole body."""
    return bodies(spark, d).select("doc_id", tx.classifier_text(F.col("subject"), F.col("body"), unicode=False).alias("text"))


def _words():
    return tfidf.pieces("word", F.col("text"), _ASCII_WORD), "word"


@query("tf_word", _WORDS + "SELECT * FROM tf", E)
def tf_word(spark, d):
    return tfidf.term_counts(_texts(spark, d), *_words())


@query("df_word", _WORDS + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term", E)
def df_word(spark, d):
    return tfidf.document_counts(_texts(spark, d), *_words())


@query("tfidf_weight", _WORDS + ", df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n.n) / (1.0 + df)) + 1) AS raw FROM tf JOIN df USING (term), n) SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 9) AS weight FROM r", E)
def tfidf_weight(spark, d):
    texts = _texts(spark, d)
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    return tfidf.chunk_weights(texts, "text", n, "word", _ASCII_WORD).withColumn("weight", F.round("weight", 9))


_GRAMS = ", t AS (SELECT doc_id, " + _TEXT + """ AS text FROM emails), a AS (SELECT doc_id, string_split(text, '') AS cs FROM t),
c AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM a),
w AS (SELECT doc_id, c || lead(c, 1) OVER x || lead(c, 2) OVER x AS g, lead(c, 3) OVER x AS d, lead(c, 4) OVER x AS e FROM c WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, unnest([g, g || d, g || d || e]) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g WHERE term IS NOT NULL GROUP BY doc_id, term) """


@query("tf_char", _GRAMS + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term", E)
def tf_char(spark, d):
    return tfidf.document_counts(_texts(spark, d), tfidf.pieces("char", F.col("text")), "char")


# ---- evaluation ----------------------------------------------------------------------------------


@query("confusion_matrix", "SELECT c.y_true, " + ", ".join(f"count(*) FILTER (WHERE p.y_pred = {k}) AS pred_{k}" for k in range(4)) + " FROM (VALUES (0), (1), (2), (3)) c(y_true) LEFT JOIN predictions p ON p.y_true = c.y_true GROUP BY c.y_true", P)
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(predictions(spark, d))


_REPORT = ", r AS (SELECT c.class, (SELECT count(*) FROM predictions WHERE y_true = c.class AND y_pred = c.class) AS tp, (SELECT count(*) FROM predictions WHERE y_pred = c.class) AS p, (SELECT count(*) FROM predictions WHERE y_true = c.class) AS t FROM (VALUES (0), (1), (2), (3)) c(class)), report AS (SELECT class, CASE WHEN p = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / p END AS precision, CASE WHEN t = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / t END AS recall, CASE WHEN p + t = 0 THEN 0.0 ELSE 2.0 * tp / (p + t) END AS f1, t AS support FROM r) "


@query("four_class_report", _REPORT + "SELECT * FROM report", P)
def four_class_report(spark, d):
    return metrics.class_report(predictions(spark, d))


@query("prediction_join", ", t AS (SELECT doc_id, y_true FROM predictions WHERE doc_id % 5 > 0), p AS (SELECT doc_id, y_pred FROM predictions WHERE doc_id % 3 > 0) SELECT y_true, y_pred, count(*) AS n FROM t JOIN p USING (doc_id) GROUP BY ALL", P)
def prediction_join(spark, d):
    """Truth and predictions from two tables, by id."""
    p = predictions(spark, d)
    both = metrics.scored(p.select("doc_id", "y_true").filter("doc_id % 5 > 0"), p.select("doc_id", "y_pred").filter("doc_id % 3 > 0"))
    return both.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


@query("four_class_summary", _REPORT + "SELECT round(sum(recall * support) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM report", P)
def four_class_summary(spark, d):
    s = metrics.summary(predictions(spark, d))
    return s.select(*(F.round(c, 9).alias(c) for c in s.columns))


def _binary_sql(classes: str) -> str:
    return f", c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE NOT t AND NOT p) AS tn, count(*) FILTER (WHERE t AND NOT p) AS fn FROM (SELECT y_true IN {classes} AS t, y_pred IN {classes} AS p FROM predictions)) SELECT *, CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr, 1 - coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS bypass_rate FROM c"


@query("phishing_metrics", _binary_sql("(1, 3)"), P)
def phishing_metrics(spark, d):
    return metrics.binary_metrics(predictions(spark, d))


@query("ai_metrics", _binary_sql("(2, 3)"), P)
def ai_metrics(spark, d):
    return metrics.binary_metrics(predictions(spark, d), metrics.GENERATED)


_SYSTEMS = ", w AS (SELECT *, CAST(floor(10 * (p1 + p3)) AS INT) AS s FROM predictions), r AS (SELECT 'classifier' AS system, y_true, y_pred IN (1, 3) AS flagged, latency_ms FROM w UNION ALL SELECT 'daemon', y_true, CASE WHEN doc_id % 41 > 0 THEN s >= 5 END, CAST(doc_id % 31 AS DOUBLE) / 8 FROM w UNION ALL SELECT 'service', y_true, s >= 4, CAST(doc_id % 17 AS DOUBLE) / 2 FROM w)"


@query("systems_side_by_side", _SYSTEMS + """, f AS (SELECT *, coalesce(flagged, false) AS hit FROM r), c AS (SELECT system, count(*) AS n, count(*) FILTER (WHERE flagged IS NULL) AS unanswered,
count(*) FILTER (WHERE y_true IN (1, 3) AND hit) AS tp, count(*) FILTER (WHERE y_true IN (0, 2) AND hit) AS fp, count(*) FILTER (WHERE y_true IN (0, 2) AND NOT hit) AS tn, count(*) FILTER (WHERE y_true IN (1, 3) AND NOT hit) AS fn,
count(*) FILTER (WHERE y_true = 0 AND hit) AS human_benign_alarms, count(*) FILTER (WHERE y_true = 0) AS human_benign, count(*) FILTER (WHERE y_true = 2 AND hit) AS generated_benign_alarms, count(*) FILTER (WHERE y_true = 2) AS generated_benign,
CAST(count(*) FILTER (WHERE y_true = 1 AND hit) AS DOUBLE) / count(*) FILTER (WHERE y_true = 1) AS human_phishing_recall, CAST(count(*) FILTER (WHERE y_true = 3 AND hit) AS DOUBLE) / count(*) FILTER (WHERE y_true = 3) AS generated_phishing_recall,
round(avg(latency_ms) FILTER (WHERE latency_ms > 0), 6) AS mean_ms, round(median(latency_ms) FILTER (WHERE latency_ms > 0), 6) AS median_ms, round(quantile_cont(latency_ms, 0.95) FILTER (WHERE latency_ms > 0), 6) AS p95_ms, round(1000 / avg(latency_ms) FILTER (WHERE latency_ms > 0), 6) AS per_second FROM f GROUP BY system)
SELECT *, 1 - generated_phishing_recall AS generated_phishing_bypass, CAST(tp + tn AS DOUBLE) / n AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision, CAST(tp AS DOUBLE) / (tp + fn) AS recall, 2.0 * tp / (2 * tp + fp + fn) AS f1, CAST(fp AS DOUBLE) / (fp + tn) AS fpr FROM c""", P)
def systems_side_by_side(spark, d):
    """A classifier and two filters, whose replies are texts, over the same records."""
    w = predictions(spark, d).withColumn("s", F.floor(10 * (F.col("p1") + F.col("p3"))).cast("int"))
    daemon = F.expr("CASE WHEN doc_id % 41 > 0 THEN concat('Spam: ', CASE WHEN s >= 5 THEN 'True' ELSE 'False' END, ' ; ', s, ' / 5') END")
    service = F.expr("""concat('{"score": ', s, ', "action": "', CASE WHEN s >= 7 THEN 'reject' WHEN s >= 4 THEN 'add header' ELSE 'no action' END, '"}')""")
    systems = {
        "classifier": (F.col("y_pred").isin(*metrics.PHISHING), F.col("latency_ms")),
        "daemon": (F.when(daemon.isNotNull(), metrics.daemon_verdict(daemon)["is_spam"]), F.expr("cast(doc_id % 31 as double) / 8")),
        "service": (metrics.service_verdict(service)["is_spam"], F.expr("cast(doc_id % 17 as double) / 2")),
    }
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("system"), f.alias("flagged"), ms.alias("latency_ms")) for k, (f, ms) in systems.items())))
    out = metrics.side_by_side(w.select("y_true", rows))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ms", "median_ms", "p95_ms", "per_second")})


@query("cohort_fpr", "SELECT y_true AS cohort, avg(CASE WHEN y_pred IN (1, 3) THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM predictions GROUP BY y_true", P)
def cohort_fpr(spark, d):
    return metrics.cohort_rates(predictions(spark, d))


_AREAS = ", l AS (" + " UNION ALL ".join(f"SELECT {k} AS class, p{k} AS score, y_true = {k} AS hit FROM predictions" for k in range(4)) + "), r AS (SELECT class, hit, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS rk FROM l), s AS (SELECT class, sum(rk) FILTER (WHERE hit) AS w, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n FROM r GROUP BY class)"


@query("roc_auc_ovr", _AREAS + " SELECT class, (w - p * (p + 1) / 2.0) / (p * n) AS auc FROM s", P)
def roc_auc_ovr(spark, d):
    return metrics.auc_one_vs_rest(predictions(spark, d))


@query("roc_auc_macro", _AREAS + " SELECT round(avg((w - p * (p + 1) / 2.0) / (p * n)), 9) AS auc FROM s", P)
def roc_auc_macro(spark, d):
    return metrics.macro_auc(predictions(spark, d)).select(F.round("auc", 9).alias("auc"))


@query("latency_stats", "SELECT round(avg(latency_ms), 6) AS mean_ms, round(median(latency_ms), 6) AS median_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(1000 / avg(latency_ms), 6) AS per_second FROM predictions WHERE latency_ms > 0", P)
def latency_stats(spark, d):
    s = metrics.latency_stats(predictions(spark, d))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query("event_latency", "SELECT event_type, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events WHERE value > 0 GROUP BY event_type")
def event_latency(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").filter("value > 0")
    both = ev.groupBy("event_type").agg(F.avg("value").alias("mean_ms")).join(metrics.quantiles(ev, "value", {"median_ms": 0.5, "p95_ms": 0.95}, ["event_type"]), "event_type")
    return both.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p95_ms")))


_CLASS = "CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END"


@query("decision_rules", f", c AS (SELECT *, {_CLASS} AS k FROM predictions) SELECT doc_id, k AS predicted_class, k IN (1, 3) OR p1 + p3 >= 0.5 AS service, p1 + p3 >= 0.5 AS baseline, k IN (1, 3) AS exported FROM c", P)
def decision_rules(spark, d):
    rules = metrics.decision_rules(F.array("p0", "p1", "p2", "p3"))
    return predictions(spark, d).select("doc_id", *(c.alias(k) for k, c in rules.items()))


@query("argmax_label", f"SELECT {_CLASS} AS predicted_class, count(*) AS n FROM predictions GROUP BY 1", P)
def argmax_label(spark, d):
    return predictions(spark, d).groupBy(metrics.best_class(F.array("p0", "p1", "p2", "p3")).alias("predicted_class")).agg(F.count("*").alias("n"))


_REPLY = "CASE doc_id % 4 WHEN 0 THEN 'SPAMD/1.1 0 EX_OK' || chr(13) || chr(10) || 'Spam: True ; ' || CAST(doc_id % 20 AS VARCHAR) || '.5 / 5.0' WHEN 1 THEN 'Spam: no;-1.2/5.0' WHEN 2 THEN 'spam: YES ; 7 / 6' ELSE 'error' END"


@query("spamd_parse", f", r AS (SELECT doc_id, {_REPLY} AS reply FROM emails), p AS (SELECT doc_id, lower(regexp_extract(reply, '{metrics.DAEMON_REPLY}', 1)) IN ('true', 'yes') AS is_spam, coalesce(TRY_CAST(regexp_extract(reply, '{metrics.DAEMON_REPLY}', 2) AS DOUBLE), 0.0) AS score, coalesce(TRY_CAST(regexp_extract(reply, '{metrics.DAEMON_REPLY}', 3) AS DOUBLE), 5.0) AS threshold FROM r) SELECT *, CASE WHEN is_spam THEN 'spam' ELSE 'ham' END AS action FROM p", E)
def spamd_parse(spark, d):
    e = bodies(spark, d).selectExpr("doc_id", _REPLY.replace("AS VARCHAR", "AS STRING") + " AS reply")
    return e.select("doc_id", *(c.alias(k) for k, c in metrics.daemon_verdict(F.col("reply")).items()))


@query("rspamd_parse", ", r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'add header' WHEN 2 THEN 'no action' END AS a FROM emails) SELECT doc_id, coalesce(doc_id % 5 = 0, false) OR coalesce(a, 'no action') IN ('reject', 'add header') AS is_spam, CAST(doc_id % 30 AS DOUBLE) / 2 AS score, CAST(CASE WHEN doc_id % 2 = 0 THEN 12 ELSE 15 END AS DOUBLE) AS threshold, coalesce(a, 'no action') AS action, CASE WHEN doc_id % 3 = 0 THEN ['A', 'B'] ELSE CAST([] AS VARCHAR[]) END AS symbols FROM r", E)
def rspamd_parse(spark, d):
    reply = """concat('{"score": ', cast(cast(doc_id % 30 as double) / 2 as string), CASE WHEN doc_id % 2 = 0 THEN ', "required_score": 12' ELSE '' END,
    CASE doc_id % 4 WHEN 0 THEN ', "action": "reject"' WHEN 1 THEN ', "action": "add header"' WHEN 2 THEN ', "action": "no action"' ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN ', "is_spam": true' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ', "symbols": {"B": {"score": 1}, "A": {"score": 2}}' ELSE '' END, '}')"""
    e = bodies(spark, d).selectExpr("doc_id", f"{reply} AS reply")
    return e.select("doc_id", *(c.alias(k) for k, c in metrics.service_verdict(F.col("reply")).items()))


# ---- prediction ------------------------------------------------------------------------------------


def _normal_sql(c: str) -> str:
    return _lookalike_sql(rf"regexp_replace(replace(nfc_normalize({c}), chr(160), ' '), '\p{{Cf}}', '', 'g')")


_SERVED = f""", c AS (SELECT doc_id, subject, {HTML_SQL.format(c="body")} AS is_html, CASE WHEN {HTML_SQL.format(c="body")} THEN {_NORMAL.format(_normal_sql(_entities(_PIECES.replace("(html,", "(body,"))))} ELSE body END AS body FROM emails),
s AS (SELECT *, {SLICE_SQL} AS sliced FROM c), m AS (SELECT *, {_chain_sql(_normal_sql("sliced"))} AS masked, {_chain_sql(_normal_sql("subject"))} AS title FROM s)
SELECT doc_id, is_html, {_URLS} AS urls, sliced AS clean_body, masked AS masked_body, length(sliced) < length({_STRIP.format("body")}) AS thread_sliced, 'Subject: ' || {_STRIP.format("title")} || '. Body: ' || {_STRIP.format("masked")} AS text FROM m"""


@query("serve_clean", _SERVED, E)
def serve_clean(spark, d):
    e = bodies(spark, d).select("doc_id", "subject", "body")
    return flows.served(e, unicode=False).select("doc_id", "is_html", "urls", "clean_body", "masked_body", "thread_sliced", "text")


_COUNTS = ", e AS (SELECT doc_id, " + ", ".join(f"CAST(length(body) - length(replace(body, '{v}', '')) AS DOUBLE) AS e{k}" for k, v in enumerate("aeiou")) + " FROM emails)"


def _embedded(spark, d):
    """Bodies as vectors of a stand-in encoder: how often each vowel stands in them."""

    def make():
        return lambda texts: [[t.count(v) for v in "aeiou"] for t in texts]

    e = semantic.embed(bodies(spark, d).select("doc_id", "body"), make, "body", "sem")
    return e.select("doc_id", *(F.col("sem")[k].cast("double").alias(f"e{k}") for k in range(5)))


@query("semantic_embed", _COUNTS + " SELECT * FROM e", E)
def semantic_embed(spark, d):
    return _embedded(spark, d)


_LOGITS = tuple("(" + " + ".join(f"{(3 * c + 7 * k) % 11 - 5} * e{k}" for k in range(5)) + ") / (e0 + e1 + e2 + e3 + e4 + 1)" for c in range(4))


@query("semantic_proba", _COUNTS + ", l AS (SELECT doc_id, " + ", ".join(f"{x} AS l{c}" for c, x in enumerate(_LOGITS)) + " FROM e), x AS (SELECT doc_id, " + ", ".join(f"exp(l{c} - greatest(l0, l1, l2, l3)) AS x{c}" for c in range(4)) + " FROM l) SELECT doc_id, " + ", ".join(f"round(x{c} / (x0 + x1 + x2 + x3), 9) AS p{c}" for c in range(4)) + " FROM x", E)
def semantic_proba(spark, d):
    """Class probabilities of a linear softmax head on the embedding."""
    probs = semantic.softmax([F.expr(x) for x in _LOGITS])
    return _embedded(spark, d).select("doc_id", *(F.round(p, 9).alias(f"p{c}") for c, p in enumerate(probs)))


@query("latent_vectors")
def latent_vectors(spark, d):
    """The learned dense branch over whole texts: how much of each text's term vector its singular vectors hold."""
    texts = stored(_texts(spark, d), "texts")
    rows = stored(tfidf.Stylometric().fit(texts).transform(texts).select("doc_id", "stylo"), "style")
    return latent.held_shares(rows, latent.fit(rows, kept=True)).select("doc_id", F.round("held", 6).alias("held"))


def _vectors(spark, d):
    """Dense vectors with classes, from the embeddings."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.col("label") % 4).alias("label"))
    return sampling.stratified_split(v, "label", key="vec_id")


@query("head_logistic")
def head_logistic(spark, d):
    v = _vectors(spark, d)
    model = heads.train(v.filter("split = 'train'"), "logistic")
    return model.transform(v.filter("split = 'test'")).select("vec_id", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


@query("head_random_forest")
def head_random_forest(spark, d):
    v = _vectors(spark, d)
    model = heads.train(v.filter("split = 'train'"), "rf")
    out = flows.predict(v.filter("split = 'test'").withColumn("text", F.lit("")), model)
    return out.select("vec_id", "predicted_class", "is_phishing", F.round(F.element_at("probabilities", "human_benign"), 6).alias("human_benign"))


@query("head_boosted")
def head_boosted(spark, d):
    """Softmax boosting with a stop by held rows: probabilities of the test split as its ONNX file gives them."""
    v = _vectors(spark, d)
    model = heads.train(v.filter("split <> 'test'"), "boosted", "split = 'val'", rounds=12, depth=3, eta=0.3, patience=2)
    out = portable.score(v.filter("split = 'test'"), portable.to_onnx(model))
    return out.select("vec_id", *(F.round(F.col("probs")[c].cast("double"), 4).alias(f"p{c}") for c in range(4)))


def _net_query(spark, d, name):
    v = _vectors(spark, d)
    model = heads.train(v.filter("split <> 'test'"), name, "split = 'val'", epochs=8, patience=2)
    return model.transform(v.filter("split = 'test'")).select("vec_id", F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


@query("head_perceptron")
def head_perceptron(spark, d):
    return _net_query(spark, d, "perceptron")


@query("head_convolution")
def head_convolution(spark, d):
    return _net_query(spark, d, "cnn")


@query("head_portable")
def head_portable(spark, d):
    """The logistic head's probabilities as its ONNX file gives them."""
    v = _vectors(spark, d)
    model = heads.train(v.filter("split = 'train'"), "logistic")
    out = portable.score(v.filter("split = 'test'"), portable.to_onnx(model))
    return out.select("vec_id", *(F.round(F.col("probs")[c].cast("double"), 4).alias(f"p{c}") for c in range(4)))


# ---- streams -----------------------------------------------------------------------------------------


@query("windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    w = ingest.windowed_events(spark.read.parquet(f"{d}/events.parquet"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


_GAPS = "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) "


@query("event_sessions", _GAPS + "SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k")
def event_sessions(spark, d):
    s = ingest.sessions(spark.read.parquet(f"{d}/events.parquet"))
    return s.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def _event_stream(spark, d):
    """The events as a stream, times in whole milliseconds."""
    path = f"{d}/events.parquet"
    ev = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern may name a file, a plain path only a folder
    return ev.select("event_id", "user_id", "event_type", F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts"))


def _ran(df: DataFrame, name: str) -> DataFrame:
    """What a stream has written once it has read all there is."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


_CLOSED = _GAPS.replace("user_id, ts, CASE", "user_id, date_trunc('millisecond', ts) AS ts, CASE").replace("ts < lag(ts)", "date_trunc('millisecond', ts) < lag(date_trunc('millisecond', ts))")


@query("stream_silent_users", _CLOSED + "SELECT user_id, min(ts) AS begin, max(ts) AS last, count(*) AS n FROM k GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 10 MINUTE")
def stream_silent_users(spark, d):
    """Keyed state and timers: the stretches of users' events that the watermark has closed."""
    out = _ran(keyed.silent_keys(_event_stream(spark, d), "user_id", "ts"), "silent")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("begin", "last")), "n")


@query("stream_first_of_key", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('millisecond', ts), event_id) AS k FROM events) WHERE k = 1")
def stream_first_of_key(spark, d):
    """Streaming duplicates by keyed state: each user's first event of each type."""
    return _ran(keyed.first_of_stream(_event_stream(spark, d), ["user_id", "event_type"], "ts", "event_id", "3650 days", 10**11), "first").select("user_id", "event_type", "event_id")


# ---- extensions: what the data has and the inventory does not ask for --------------------------------


@query("ext_cube", "SELECT label, source, count(*) AS n, CAST(grouping(label, source) AS BIGINT) AS level FROM emails GROUP BY CUBE (label, source)", E)
def ext_cube(spark, d):
    return emails(spark, d).cube("label", "source").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("ext_pricing_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus")
def ext_pricing_summary(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))

"""Whole flows: preprocessing of a corpus, cleaning for prediction, prediction, evaluation."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions import features as fx
from mailloom.functions import masking as mk
from mailloom.functions import text as tx
from mailloom.functions.lookalikes import normalise_unicode, with_normal
from mailloom.operators import dedup, metrics, records
from mailloom.sources import html, mail

SCANS = {
    "enron": lambda spark, path, **o: mail.maildir(spark, path),
    "nazario": lambda spark, path, **o: mail.mbox(spark, path, 1, o.get("last_year", 2022)),
    "nigerian_fraud": lambda spark, path, **o: mail.mbox(spark, path, 1, glob="*.txt"),
    "spamassassin": lambda spark, path, **o: mail.labelled_folders(spark, path, o.get("key", "md5")),
    "trec": lambda spark, path, **o: mail.indexed(spark, path, o["index"]),
}


@dataclass
class Config:
    """What a run reads and keeps. Sources are off unless they are enabled."""

    sources: dict[str, dict[str, Any]] = field(default_factory=dict)
    min_body: int = tx.MIN_BODY
    masking: bool = False
    mode: str = "full"
    fields: tuple[str, ...] = ()
    out: str = ""

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        if not Path(path).exists():
            raise FileNotFoundError(path)
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__}
        return cls(**known | {"fields": tuple(known.get("fields", ()))})


def scan(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    if name not in SCANS:
        raise ValueError(f"unknown source {name!r}")
    return SCANS[name](spark, path, **options).withColumn("source", F.lit(name))


def scan_all(spark: SparkSession, config: Config, only: str | None = None) -> DataFrame | None:
    """The enabled sources' messages; a source without a path is left out."""
    out = None
    for name, o in config.sources.items():
        if not o.get("enabled", False) or not o.get("path") or (only and only != name):
            continue
        one = scan(spark, name, o["path"], **{k: v for k, v in o.items() if k not in ("enabled", "path")})
        out = one if out is None else out.unionByName(one)
    return out


def extracted(messages: DataFrame, min_body: int = tx.MIN_BODY) -> DataFrame:
    """Parsed, cleaned and measured messages with a status: kept, or why not. Rejections on headers come before any Python."""
    m = mail.parsed(messages)
    payload = F.coalesce(F.nullif("plain", F.lit("")), "html")
    m = m.withColumn("status", F.when(F.col("parse_error").isNotNull(), "error").when(tx.is_bounce(F.col("subject_raw")), "bounce").when(F.coalesce(payload, F.lit("")) == "", "empty"))
    m = m.withColumn("clean", F.when(F.col("status").isNull(), html.clean_payload(payload))).withColumn("body", tx.slice_thread(F.col("clean")))
    body = F.col("body")
    m = m.withColumn("status", F.coalesce("status", F.when(body == "", "empty").when(tx.is_system_body(body), "system").when(~tx.long_enough(body, min_body), "short").otherwise("kept")))
    links = m.withColumn("urls", fx.urls(F.col("plain"), F.col("html")))
    whole = {
        "sender_domain": fx.address_domain(F.col("sender")),
        "receiver_domain": fx.address_domain(F.col("receiver")),
        "language": fx.language_native(body),
        "has_attachments": (F.col("attachment_count") > 0).cast("int"),
        **fx.url_metrics(F.col("urls")),
    }
    out = links.withColumns(whole)
    return out.withColumns({"sender": fx.address_hash(F.col("sender")), "receiver": fx.address_hash(F.col("receiver"))})


def preprocess(spark: SparkSession, config: Config, only: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, counters): kept rows in the schema's shape, and counts by source and status."""
    messages = scan_all(spark, config, only)
    if messages is None:
        empty = spark.createDataFrame([], records.RECORD)
        return empty, spark.createDataFrame([], "source string, status string, n long")
    e = extracted(messages, config.min_body)
    kept = e.filter("status = 'kept'")
    one = dedup.by_fingerprint(kept, order=("path", "ordinal"))
    if config.masking:
        one = one.withColumns({"subject": mk.mask(F.col("subject")), "body": mk.mask(F.col("body"))})
        one = one.filter(tx.long_enough(F.col("body"), config.min_body))
    valid = records.with_defaults(one).filter(records.is_valid())
    return records.exported(valid, config.mode, config.fields), records.status_counts(e)


def served(df: DataFrame, subject: str = "subject", body: str = "body", native: bool = False, masking: bool = True, unicode: bool = True) -> DataFrame:
    """Adds what the prediction service makes of a message: is_html, urls, clean_body, masked_body, thread_sliced, text.

    ``thread_sliced`` says that a quoted thread was cut off; white space alone doesn't count. Without ``unicode`` classes, edges and references are those of the SQL.
    Each step is a column that the next ones read, so that no text is worked out twice; only markup goes to the parser.
    """
    given, names = tx.text(body), ("__clean", "__title", "__sliced")
    df = df.withColumn("is_html", tx.is_html(given))
    markup = F.when(F.col("is_html"), given)
    parsed = html.clean_native(markup) if native else (html.clean_payload if unicode else html.clean_payload_known)(markup)
    df = df.withColumn("__clean", F.when(F.col("is_html"), parsed).otherwise(given))
    clean = F.col("__clean")
    sliced = tx.slice_thread(clean, unicode)
    if native:
        df, normal, title = df.withColumn("clean_body", sliced), F.col("clean_body"), tx.text(subject)
    else:
        df = df.withColumn("__sliced", with_normal(sliced)).withColumn("clean_body", F.col("__sliced.given"))
        normal, title = F.col("__sliced.normal"), normalise_unicode(tx.text(subject))
    df = df.withColumns({"urls": fx.urls(clean), "thread_sliced": F.length("clean_body") < F.length(tx.strip(clean, unicode))})
    df = df.withColumns({"masked_body": mk.mask(normal, unicode=unicode, enabled=masking), "__title": mk.mask(title, unicode=unicode, enabled=masking)})
    return df.withColumn("text", tx.classifier_text(F.col("__title"), F.col("masked_body"), unicode)).drop(*names)


CLASSES = ("human_benign", "human_phishing", "generated_benign", "generated_phishing")


def features_for(mode: str) -> list[str]:
    """Vector columns of an inference mode."""
    modes = {"fusion": ["stylo", "sem"], "semantic": ["sem"], "stylometric": ["stylo"]}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}")
    return modes[mode]


def with_features(df: DataFrame, mode: str) -> DataFrame:
    """Adds the column features that an inference mode's heads read: the blocks of its branches side by side."""
    from mailloom.operators.heads import fused

    return fused(df, features_for(mode))


def predict(df: DataFrame, model, rule: str = "service") -> DataFrame:
    """Adds class, probabilities by name, the phishing verdict of a rule and a preview of the text.

    One-against-the-rest heads have margins only; their logistic values, made to sum to one, are the probabilities.
    """
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("probs", vector_to_array("probability"))
    else:
        out = out.withColumn("probs", F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x))))
        out = out.withColumn("probs", F.transform("probs", lambda x: x / F.aggregate("probs", F.lit(0.0), lambda a, b: a + b)))
    rules = metrics.decision_rules(F.col("probs"))
    probabilities = F.map_from_arrays(F.array(*map(F.lit, CLASSES)), F.col("probs"))
    return out.withColumns({"predicted_class": rules["predicted_class"], "is_phishing": rules[rule], "probabilities": probabilities, "preview": tx.preview(F.col("text"))}).drop("probs")


def predict_messages(messages: DataFrame, vectors, model, rule: str = "service") -> DataFrame:
    """id, predicted_class, is_phishing, probabilities, preview, is_html, n_urls, thread_sliced of messages (id, subject, body) that are not cleaned yet.

    ``vectors`` adds the column features to a frame with text. A message without subject and body has an error and nothing else.
    """
    m = messages.select("id", F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("body", F.lit("")).alias("body"))
    blank = (F.col("subject") == "") & (F.col("body") == "")
    ready = served(m.filter(~blank)).select(F.col("id").alias("doc_id"), "text", "is_html", F.size("urls").alias("n_urls"), "thread_sliced")
    out = predict(vectors(ready), model, rule).select(F.col("doc_id").alias("id"), "predicted_class", "is_phishing", "probabilities", "preview", "is_html", "n_urls", "thread_sliced", F.lit(None).cast("string").alias("error"))
    bad = m.filter(blank).select("id", F.lit("subject and body are empty").alias("error"))
    return out.unionByName(bad, allowMissingColumns=True)

"""Command line: preprocess, mask, validate, stats, generate, trace, train, compare, export, predict, baseline, serve."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mailloom.functions import masking as mk
from mailloom.operators import heads, metrics, records, sampling
from mailloom.operators.generation import VERSIONS
from mailloom.operators.tfidf import Stylometric
from mailloom.plans import flows, training
from mailloom.sources import mail, runs, sinks

COHORTS = ("human_benign", "human_phishing", "generated_benign", "generated_phishing")


def preprocess(spark: SparkSession, a: argparse.Namespace) -> int:
    config = flows.Config.load(a.config)
    kept, counts = flows.preprocess(spark, config, a.source)
    if a.run_name:  # whole or not at all, and the same run again replaces itself
        runs.write_run(kept, a.out or config.out, a.source or "all", a.run_name, "json", ("label",), ignoreNullFields=True)
    else:
        sinks.write_by_label(kept, a.out or config.out)
    counts.show(100, False)
    return 0


def mask(spark: SparkSession, a: argparse.Namespace) -> int:
    from mailloom.streaming.ingest import mask_stream

    if a.resume:
        mask_stream(spark, a.input, a.out, f"{a.out}/_checkpoint").awaitTermination()
        return 0
    rows = mail.json_lines(spark, a.input).withColumns({"subject": mk.mask(F.col("subject")), "body": mk.mask(F.col("body"))})
    sinks.write_json_lines(rows, a.out, "overwrite")
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = spark.read.text(a.input).filter(F.col("value").rlike(r"\S")).select(F.from_json("value", records.CHECKED, {"columnNameOfCorruptRecord": records.BAD_ROW}).alias("r")).select("r.*")
    found = records.validation_counts(lines).first().asDict()
    print(json.dumps(found))
    return int(found["invalid"] > 0)


def stats(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = mail.json_lines(spark, a.input).withColumns({"source": F.coalesce("source", F.lit("unknown"))})
    records.label_source_counts(rows).orderBy("level", F.col("n").desc(), "label", "source").show(1000, False)
    return 0


def trace(spark: SparkSession, a: argparse.Namespace) -> int:
    """Generated rows, in any of the forms that replies come in, with their seeds. --samples is the quota that each model was generated with; --share divides it among the models, as jobs that share one quota do."""
    from mailloom.operators.generation import parsed_lines

    seeds = mail.seed_rows(spark, a.seeds)
    made = parsed_lines(spark, a.input).select("source", "seed_idx")
    models = sorted(r["source"] for r in made.filter("source is not null").select("source").distinct().collect())
    quota = sampling.quotas(a.samples, models) if a.share and models else dict.fromkeys(models, a.samples)
    n = seeds.count()
    sampling.check_traceable(made, {m: int(q * (1 + sampling.BUFFER)) if n else 0 for m, q in quota.items()})
    found = sampling.trace(made, sampling.seed_pool(spark, seeds, n, quota, a.seed))
    if a.out:
        sinks.write_json_lines(found, a.out, "overwrite")
    found.orderBy("source", "seed_idx").show(a.show, False)
    return 0


def _cohorts(spark: SparkSession, paths: list[str]):
    out = None
    for k, path in enumerate(paths):
        one = mail.cohort_lines(spark, path, k).withColumn("doc_id", F.concat_ws("/", F.lit(k), "id"))
        out = one if out is None else out.unionByName(one)
    return out


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    for head in a.head:
        _, scores = training.train(_cohorts(spark, a.cohorts), training.Training(head=head, per_cohort=a.samples, mode=a.mode, size=a.size), a.out, resume=not a.fresh)
        print(json.dumps({"head": head} | scores.first().asDict()))
    return 0


def compare(spark: SparkSession, a: argparse.Namespace) -> int:
    """Heads side by side on the split that training left."""
    t = training.Training(per_cohort=a.samples, mode=a.mode, size=a.size)
    vectors = training.vectors(_cohorts(spark, a.cohorts), t, a.out, resume=not a.fresh)[0].persist()
    found = heads.compare(vectors.filter("split = 'train'"), vectors.filter("split = 'test'"), a.head)
    sinks.write_report(found, f"{a.out}/comparison")
    found.show(100, False)
    return 0


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    """A trained head as an ONNX file."""
    from pyspark.ml import PipelineModel

    from mailloom.operators import portable

    with open(a.out, "wb") as f:
        f.write(portable.to_onnx(PipelineModel.load(a.model).stages[-1]))
    return 0


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    """A cohort from seeds; --provider is http, with --url, or module:class."""
    import importlib

    from mailloom.operators import generation

    if ":" in a.provider:
        module, cls = a.provider.split(":")
        generation.register_provider(a.provider, getattr(importlib.import_module(module), cls))
    options = {"url": a.url, "model": a.model, "key": generation.api_key(a.key, None, "MAILLOOM_KEY"), "form": a.form} if a.provider == "http" else {}
    client = generation.provider(a.provider, **options)
    seeds = [r.asDict() for r in mail.seed_rows(spark, a.seeds).orderBy("position").select("subject", "body").collect()]  # the seeds of one job
    done = mail.json_lines(spark, a.out).filter(F.col("source") == a.model) if mail.count_lines(spark, a.out) else None
    written = done.count() if done is not None else 0
    start = sampling.resume_at(done, a.batch, "source").first() if written else None
    job = generation.Job(a.model, a.samples, a.kind, a.version, a.batch, a.seed)
    with open(a.out, "a", encoding="utf-8") as f:  # whole batches, so that a run that stops can go on
        for rows in generation.generate(job, seeds, client, int(a.kind == "phishing"), int(start["position"]) if start else 0, written):
            f.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
            f.flush()
            written += len(rows)
    print(json.dumps({"model": a.model, "written": written}))
    return int(written < a.samples)


def _models(a: argparse.Namespace):
    from pyspark.ml import PipelineModel

    spark = SparkSession.getActiveSession()
    stylo, model = Stylometric.load(spark, a.stylo), PipelineModel.load(a.model)
    if a.mode == "stylometric":
        return lambda df: stylo.transform(df, "text", "features"), model
    if not a.latent:
        raise ValueError(f"mode {a.mode} needs --latent")
    dense = PipelineModel.load(a.latent)
    return lambda df: flows.with_features(dense.transform(stylo.transform(df, "text", "stylo")), a.mode), model


def predict(spark: SparkSession, a: argparse.Namespace) -> int:
    """Messages of a JSON-lines cohort, of one JSON object, of plain text or of raw mail to predictions."""
    if a.subject or a.body:
        rows = spark.createDataFrame([("message", a.subject, a.body)], "id string, subject string, body string")
    elif not a.input:
        raise ValueError("give --input, --subject or --body")
    elif a.form == "lines":
        rows = mail.cohort_lines(spark, a.input, 0).select("id", "subject", "body")
    else:
        rows = mail.one_message(spark, a.input) if a.form == "one" else mail.raw_messages(mail.files(spark, a.input))
    out = flows.predict_messages(rows, *_models(a), a.rule)
    out.withColumnRenamed("id", "doc_id").write.mode("overwrite").json(a.out)
    return 0


def serve(spark: SparkSession, a: argparse.Namespace) -> int:
    """Raw messages that arrive in a folder to predictions, each once (run again, it takes what is new); or with --port, an HTTP server."""
    from mailloom import serving
    from mailloom.streaming import ingest

    vectors, model = _models(a)
    if a.port:
        serving.server(serving.Service(spark, {a.mode: (vectors, model)}, rule=a.rule, default_mode=a.mode), a.port, a.host).serve_forever()
        return 0
    if not (a.input and a.out):
        raise ValueError("give --input and --out, or --port")
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(a.input)
    ingest.predictions(raw, a.out, f"{a.out}/_checkpoint", lambda part: flows.predict_messages(mail.raw_messages(part), vectors, model, a.rule)).awaitTermination()
    return 0


def baseline(spark: SparkSession, a: argparse.Namespace) -> int:
    """Replies of external filters (record_id, y_true, reply, latency_ms as JSON lines), one --input for each --engine, to their metrics; with several, or with --predictions of our own, side by side over the same records."""
    if len(a.input) != len(a.engine):
        raise ValueError("give an --engine for each --input")
    systems = []
    for path, engine in zip(a.input, a.engine, strict=True):
        rows = spark.read.schema("record_id string, y_true int, reply string, latency_ms double").json(path)
        verdict = (metrics.daemon_verdict if engine == "spamd" else metrics.service_verdict)(F.col("reply"))
        systems.append(rows.select(F.lit(engine).alias("system"), "record_id", "y_true", F.when(F.col("reply").isNotNull(), verdict["is_spam"]).alias("flagged"), "latency_ms"))
    if len(systems) == 1 and not a.predictions and not a.out:
        scored = systems[0].select("y_true", "latency_ms", F.coalesce(F.col("flagged").cast("int"), F.lit(0)).alias("y_pred"))
        print(json.dumps(metrics.binary_metrics(scored).first().asDict() | metrics.latency_stats(scored).first().asDict()))
        return 0
    if a.predictions:
        ours = spark.read.schema("doc_id string, is_phishing boolean, latency_ms double").json(a.predictions)
        truth = systems[0].select("record_id", "y_true").dropDuplicates(["record_id"])
        found = truth.join(ours, F.col("record_id") == F.col("doc_id"), "left")
        systems.append(found.select(F.lit("classifier").alias("system"), "record_id", "y_true", F.col("is_phishing").alias("flagged"), "latency_ms"))
    every = systems[0]
    for s in systems[1:]:
        every = every.unionByName(s)
    report = metrics.side_by_side(every).persist()  # a row for each system
    if a.out:
        sinks.write_report(report, a.out)
    metrics.transposed(report).show(100, False)
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="mailloom")
    sub = top.add_subparsers(required=True)

    def verb(f, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(f.__name__, help=(f.__doc__ or f.__name__).strip())
        for name, how in options:
            p.add_argument(name, **how)
        p.set_defaults(run=f)

    needed, many = {"required": True}, {"required": True, "nargs": "+"}
    verb(preprocess, ("--config", needed), ("--source", {}), ("--out", {}), ("--run-name", {}))
    verb(mask, ("--input", needed), ("--out", needed), ("--resume", {"action": "store_true"}))
    verb(validate, ("--input", needed))
    verb(stats, ("--input", needed))
    verb(trace, ("--input", needed), ("--seeds", needed), ("--samples", {"type": int, "default": 14_000}), ("--share", {"action": "store_true"}), ("--seed", {"type": int, "default": 42}), ("--out", {}), ("--show", {"type": int, "default": 20}))
    mode = ("--mode", {"default": "stylometric", "choices": ["stylometric", "semantic", "fusion"]})
    size = ("--size", {"type": int, "default": 64})
    verb(train, mode, size, ("--cohorts", many), ("--head", {"nargs": "+", "default": ["rf"]}), ("--samples", {"type": int, "default": 16_000}), ("--out", needed), ("--fresh", {"action": "store_true"}))
    rule = ("--rule", {"default": "service", "choices": ["service", "baseline", "exported"]})
    verb(compare, mode, size, ("--cohorts", many), ("--head", {"nargs": "+", "default": ["rf", "logistic"]}), ("--samples", {"type": int, "default": 16_000}), ("--out", needed), ("--fresh", {"action": "store_true"}))
    verb(export, ("--model", needed), ("--out", needed))
    verb(generate, ("--seeds", needed), ("--provider", needed), ("--url", {}), ("--key", {}), ("--form", {"default": "chat", "choices": ["chat", "messages"]}), ("--model", needed), ("--samples", {"type": int, "default": 14_000}), ("--kind", {"default": "benign", "choices": ["benign", "phishing"]}), ("--version", {"default": "v2", "choices": list(VERSIONS)}), ("--batch", {"type": int, "default": 10}), ("--seed", {"type": int, "default": 42}), ("--out", needed))
    verb(predict, mode, ("--latent", {}), ("--input", {}), ("--form", {"default": "lines", "choices": ["lines", "one", "raw"]}), ("--subject", {"default": ""}), ("--body", {"default": ""}), ("--stylo", needed), ("--model", needed), rule, ("--out", needed))
    verb(serve, mode, ("--latent", {}), ("--input", {}), ("--stylo", needed), ("--model", needed), rule, ("--out", {}), ("--port", {"type": int}), ("--host", {"default": "127.0.0.1"}))
    verb(baseline, ("--input", many), ("--engine", {"nargs": "+", "default": ["spamd"], "choices": ["spamd", "rspamd"]}), ("--predictions", {}), ("--out", {}))
    a = top.parse_args(argv)
    return a.run(SparkSession.builder.appName("mailloom").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())

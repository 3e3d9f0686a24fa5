"""Runs that are killed, repeated or spread over micro-batches give their rows once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from mailloom.sources import runs
from mailloom.streaming import ingest


def values(spark, target, source=None):
    return sorted(r["v"] for r in runs.read_runs(spark, target, source).collect())


def frame(spark, *v):
    return spark.createDataFrame([(x, f"t{x}") for x in v], "v int, text string")


def test_same_run_replaces_and_others_add(spark, tmp_path):
    t = str(tmp_path / "t")
    assert runs.runs(spark, t) == []
    with pytest.raises(FileNotFoundError):
        runs.read_runs(spark, t)
    assert runs.write_run(frame(spark, 1, 2), t, "a/b c", "1") == 2
    runs.write_run(frame(spark, 3), t, "a/b c", "2")
    runs.write_run(frame(spark, 4, 4), t, "other", "1")
    assert values(spark, t) == [1, 2, 3, 4, 4] and values(spark, t, "a/b c") == [1, 2, 3]
    runs.write_run(frame(spark, 9), t, "a/b c", "1")
    assert values(spark, t) == [3, 4, 4, 9]
    assert runs.write_run(frame(spark), t, "a/b c", "2") == 0
    assert values(spark, t) == [4, 4, 9] and [(x["source"], x["run"], x["rows"]) for x in runs.runs(spark, t)] == [("a/b c", "1", 1), ("a/b c", "2", 0), ("other", "1", 2)]
    for bad in ((None, "1"), ("a", ""), ("", "1")):
        with pytest.raises(ValueError):
            runs.write_run(frame(spark, 1), t, *bad)


def test_killed_runs_are_not_seen(spark, tmp_path, monkeypatch):
    t = str(tmp_path / "t")
    runs.write_run(frame(spark, 1), t, "a", "1")
    broken = frame(spark, *range(20)).withColumn("v", F.when(F.col("v") == 19, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        runs.write_run(broken, t, "a", "1")  # a task dies while others have written
    assert values(spark, t) == [1]

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(runs, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            runs.write_run(frame(spark, 7, 8), t, "a", "2")  # dies when all is written and nothing published
    assert values(spark, t) == [1]
    assert runs.vacuum(spark, t) == 0  # too young to be left over
    assert runs.vacuum(spark, t, -1) == 2 and values(spark, t) == [1] and len(os.listdir(f"{t}/data")) == 1
    runs.write_run(frame(spark, 7, 8), t, "a", "2")
    assert values(spark, t) == [1, 7, 8]


def test_folders_forms_and_new_columns(spark, tmp_path):
    t = str(tmp_path / "t")
    rows = spark.createDataFrame([(0, "x"), (1, None), (None, "z")], "label int, v string")
    runs.write_run(rows, t, "s", "1", "json", ("label",), ignoreNullFields=True)
    folder = runs.runs(spark, t)[0]["data"]
    assert {"__label=0", "__label=1"} <= set(os.listdir(f"{t}/{folder}"))
    runs.write_run(rows.withColumn("extra", F.lit(5)), t, "s", "2")
    got = {(r.label, r.v, r.extra) for r in runs.read_runs(spark, t).collect()}
    assert got == {(r.label, r.v, x) for r in rows.collect() for x in (None, 5)}
    assert runs.read_runs(spark, t).filter("extra is null").count() == 3


SCHEMA = "source string, seed_idx int, body string, is_valid boolean"


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def go(spark, base):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    q = ingest.published_batches(stream, f"{base}/out", f"{base}/cp", 3)
    q.awaitTermination(120)
    if q.exception() is not None:
        raise RuntimeError(q.exception())
    return sorted((r["source"], r["seed_idx"]) for r in runs.read_runs(spark, f"{base}/out").collect())


def test_batches_over_micro_batches(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    one = lambda s, i, ok=True: {"source": s, "seed_idx": i, "body": "b", "is_valid": ok}
    put(f"{base}/in", "1", [one("a", 0), one("a", 1), one("b", 0), one(None, 0)])
    assert go(spark, base) == []
    put(f"{base}/in", "2", [one("a", 2), one("b", 1, None), one("b", 1), one("b", 3), one("a", 1)])
    assert go(spark, base) == [("a", 0), ("a", 1), ("a", 2)]
    put(f"{base}/in", "3", [one("b", 2), one("b", 4), one("b", 5)])

    publish = runs.publish

    def die(spark_, target, source, run, staged):
        publish(spark_, target, source, run, staged)
        raise RuntimeError("killed")  # after the rows are out, before the micro-batch is marked as done

    with monkeypatch.context() as m:
        m.setattr(runs, "publish", die)
        with pytest.raises(Exception):
            go(spark, base)
    done = [("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5)]
    assert go(spark, base) == done  # the batch with an invalid row never comes, the others once
    put(f"{base}/in", "4", [one("c", 0)])
    assert go(spark, base) == done
    at = f"{base}/out/_open"
    (query,) = os.listdir(at)
    assert len(os.listdir(f"{at}/{query}")) == 2
    left = spark.read.parquet(f"{at}/{query}/3").filter("__state = 'open'").collect()
    assert [(r["source"], r["seed_idx"]) for r in left] == [("c", 0)]

"""A sink of whole runs: what a run writes appears at once, and the same run written again takes its place.

Spark writes a run's rows below a name that is used once. Then one small file, which says where they are, is moved
into place; readers follow these files alone. A run that is killed before the move leaves nothing that anyone reads,
one that is killed after it is done. Works on any file system with a rename that replaces in one step.

A source and a run name what is written: another run of the source adds to it, the same run replaces itself.
Null or empty names are refused, names may hold any characters, an empty frame is a run without rows.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "_runs"
DATA = "data"


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _replace(spark: SparkSession, at, text: str) -> None:
    """A small file put in place by one rename over what was there."""
    jvm = spark._jvm
    draft = _path(spark, at.getParent().toString(), f".{uuid.uuid4().hex}")
    out = _files(spark, at).create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, at, how)


def stage(df: DataFrame, target: str, form: str = "parquet", by: tuple[str, ...] = (), **options) -> dict:
    """Writes rows where no reader looks yet; what :func:`publish` needs to know of them. ``by`` names columns that folders are made for, which stay in the files too."""
    folders = {f"__{c}": F.col(c) for c in by}
    name, seen = f"{DATA}/{int(time.time() * 1000):013d}-{uuid.uuid4().hex}", Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumns(folders).write.options(**options)
    (w.partitionBy(*folders) if by else w).format(form).save(f"{target}/{name}")
    return {"data": name, "form": form, "rows": int(seen.get["n"]), "schema": df.schema.jsonValue()}


def publish(spark: SparkSession, target: str, source: str, run: str, staged: dict) -> None:
    """Makes staged rows the run's, in one step."""
    if not source or not run:
        raise ValueError("a run needs a source and a name")
    key = hashlib.sha256(json.dumps([source, run]).encode()).hexdigest()
    _replace(spark, _path(spark, target, COMMITS, f"{key}.json"), json.dumps({"source": source, "run": run, **staged}) + "\n")


def write_run(df: DataFrame, target: str, source: str, run: str, form: str = "parquet", by: tuple[str, ...] = (), **options) -> int:
    """Writes a whole run or nothing; the number of rows."""
    if not source or not run:
        raise ValueError("a run needs a source and a name")
    staged = stage(df, target, form, by, **options)
    publish(df.sparkSession, target, source, run, staged)
    return staged["rows"]


def runs(spark: SparkSession, target: str) -> list[dict]:
    """What is published, by source and run; a line for each run, no rows."""
    at = _path(spark, target, COMMITS)
    if not _files(spark, at).exists(at):
        return []
    found = [json.loads(r[0]) for r in spark.read.option("pathGlobFilter", "*.json").text(f"{target}/{COMMITS}").collect()]
    return sorted(found, key=lambda x: (x["source"], x["run"]))


def read_runs(spark: SparkSession, target: str, source: str | None = None) -> DataFrame:
    """The rows of all published runs, or of one source's; columns that some runs lack are null there."""
    shapes: dict[tuple[str, str], list[str]] = {}
    for x in runs(spark, target):
        if source is None or x["source"] == source:
            shapes.setdefault((x["form"], json.dumps(x["schema"])), []).append(f"{target}/{x['data']}")
    if not shapes:
        raise FileNotFoundError(f"no published runs in {target}")
    out = None
    for (form, schema), paths in shapes.items():
        fields = T.StructType.fromJson(json.loads(schema))
        # folders are read as what they are, files below a path of data
        one = spark.read.schema(fields).option("recursiveFileLookup", True).format(form).load(paths)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def vacuum(spark: SparkSession, target: str, older_s: float = 7 * 24 * 3600) -> int:
    """Removes rows that no run names and that were begun longer ago than ``older_s``, which must outlast any run and any reader; the number of what is removed."""
    named, at = {x["data"] for x in runs(spark, target)}, _path(spark, target, DATA)
    fs = _files(spark, at)
    if not fs.exists(at):
        return 0
    border, n = (time.time() - older_s) * 1000, 0
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if f"{DATA}/{name}" not in named and int(name.split("-")[0]) <= border:
            n += int(fs.delete(f.getPath(), True))
    return n

"""The record schema, its validation, export modes and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}
_FIELDS = (
    "subject string, body string, label int, source string, seed_idx int, random_seed int, sender string, sender_domain string, receiver string, receiver_domain string, "
    "date string, content_types array<string>, urls array<string>, url_count int, url_length_max int, url_length_avg double, url_subdom_max int, url_subdom_avg double, "
    "attachment_count int, has_attachments int, attachment_types array<string>, language string"
)
RECORD = T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split(" ") for f in _FIELDS.split(", "))])
MINIMAL = ("subject", "body", "label", "source")
BAD_ROW = "_corrupt_record"
CHECKED = T.StructType([*RECORD.fields, T.StructField(BAD_ROW, T.StringType())])
"""The schema with a column for lines that don't parse."""


def is_valid() -> Column:
    """Label 0 or 1, source and body not blank; a missing value is invalid."""
    label = F.expr("try_cast(label as int)")
    return F.coalesce(label.isin(0, 1), F.lit(False)) & F.coalesce(F.col("source").rlike(r"(?U)\S"), F.lit(False)) & F.coalesce(F.col("body").rlike(r"(?U)\S"), F.lit(False))


def with_defaults(df: DataFrame) -> DataFrame:
    """All columns of the schema in its order, missing ones at their defaults."""
    zero = {"url_count", "url_length_max", "url_subdom_max", "attachment_count", "has_attachments"}
    out = []
    for f in RECORD:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in ("label", "source", "body", "seed_idx", "random_seed"):
            pass
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        elif f.name in zero or f.name.endswith("_avg"):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        else:
            c = F.coalesce(c, F.lit("en" if f.name == "language" else ""))
        out.append(c.alias(f.name))
    return df.select(*out)


def validation_counts(df: DataFrame) -> DataFrame:
    """valid, invalid, total in one aggregate; rows that could not be parsed are invalid."""
    ok = is_valid() & (F.col(BAD_ROW).isNull() if BAD_ROW in df.columns else F.lit(True))
    return df.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"), F.count("*").alias("total"))


def exported(df: DataFrame, mode: str = "full", fields: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """The columns of an export mode. No custom fields give the label alone, or with ``compat`` everything."""
    if mode == "minimal":
        return df.select(*MINIMAL)
    if mode == "custom" and (fields or not compat):
        return df.select(*dict.fromkeys([*fields, "label"]))
    if mode not in ("full", "custom"):
        raise ValueError(f"unknown export mode {mode!r}")
    return df


def equal_to(df: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns equal all the values; null equals null, and a column that isn't there is null."""
    for name, value in wanted.items():
        df = df.filter((F.col(name) if name in df.columns else F.lit(None)).eqNullSafe(F.lit(value)))
    return df


def in_language(df: DataFrame, language: str, col: str = "language") -> DataFrame:
    return df.filter(F.coalesce(F.col(col), F.lit("")) == language)


def status_counts(df: DataFrame, keys: tuple[str, ...] = ("source", "status")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def label_source_counts(df: DataFrame) -> DataFrame:
    """Counts by label, by source and over all, in one pass."""
    by = df.groupingSets([["label"], ["source"], []], "label", "source")
    return by.agg(F.count("*").alias("n"), F.grouping_id().alias("level"))

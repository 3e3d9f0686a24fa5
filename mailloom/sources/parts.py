"""The parts of messages as a table function, for SQL and for frames.

``mail_parts(raw)`` beside a table (``LATERAL``) gives a row for each part of one message; ``mail_parts(TABLE(mails))``
reads whole tables and keeps their other columns, whatever they are. ``body => 'bytes'`` gives contents as they are, ``'none'`` leaves
them out; ``raw => 'name'`` says which column holds the messages.
"""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult

FIELDS = [
    T.StructField("part", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("content_type", T.StringType()), T.StructField("charset", T.StringType()),
    T.StructField("file_name", T.StringType()), T.StructField("is_attachment", T.BooleanType()), T.StructField("size", T.LongType()),
]
BODIES = {"text": T.StringType(), "bytes": T.BinaryType(), "none": None}


def _decoded(data: bytes, charset: str | None) -> str:
    """By the charset that the part names, else UTF-8; what doesn't decode is replaced."""
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def message_parts(raw: bytes | str | None, body: str = "text") -> Iterator[tuple]:
    """FIELDS and the content of each part that holds no others, in their order; a null or empty message has none."""
    if not raw:
        return
    data = raw.encode("utf-8", "surrogateescape") if isinstance(raw, str) else bytes(raw)
    if data.startswith(b"From "):
        data = data.partition(b"\n")[2]
    # a stack, since messages within messages may lie deep
    todo, k = [(email.message_from_bytes(data, policy=email.policy.compat32), 0)], 0
    while todo:
        msg, depth = todo.pop()
        if msg.is_multipart():
            todo += [(m, depth + 1) for m in reversed(msg.get_payload())]
            continue
        content = msg.get_payload(decode=True) or b""
        name = msg.get_filename()
        charset = msg.get_content_charset()
        attached = msg.get_content_disposition() == "attachment" or name is not None
        row = (k, depth, msg.get_content_type(), charset, name, attached, len(content))
        yield row if body == "none" else (*row, _decoded(content, charset) if body == "text" else content)
        k += 1


def _constant(a: AnalyzeArgument | None, name: str, default: str) -> str:
    if a is None:
        return default
    if not a.isConstantExpression or not isinstance(a.value, str):
        raise ValueError(f"{name} must be a constant text")
    return a.value


class MailParts:
    """The table function; its columns depend on what it is given."""

    @staticmethod
    def analyze(mail: AnalyzeArgument, body: AnalyzeArgument | None = None, raw: AnalyzeArgument | None = None) -> AnalyzeResult:
        form = _constant(body, "body", "text")
        if form not in BODIES:
            raise ValueError(f"body is one of {', '.join(BODIES)}, not {form}")
        made = FIELDS + ([T.StructField("content", BODIES[form])] if BODIES[form] else [])
        if not mail.isTable:
            if not isinstance(mail.dataType, (T.BinaryType, T.StringType, T.NullType)):
                raise ValueError("a message is a text or bytes")
            return AnalyzeResult(T.StructType(made))
        column = _constant(raw, "raw", "raw")
        fields = {f.name: f for f in mail.dataType}
        if column not in fields or not isinstance(fields[column].dataType, (T.BinaryType, T.StringType)):
            raise ValueError(f"the table has no column {column} of texts or bytes")
        kept = [f for f in mail.dataType if f.name != column]
        if clash := {f.name.lower() for f in kept} & {f.name for f in made}:
            raise ValueError(f"the table's columns {', '.join(sorted(clash))} have names of the function's own: rename them")
        return AnalyzeResult(T.StructType([*kept, *made]))

    def eval(self, mail, body: str = "text", raw: str = "raw"):
        if isinstance(mail, T.Row):
            kept = tuple(mail[c] for c in mail.__fields__ if c != raw)
            mail = mail[raw]
        else:
            kept = ()
        for row in message_parts(mail, body or "text"):
            yield (*kept, *row)


def register(spark: SparkSession, name: str = "mail_parts") -> None:
    """Makes the function known to SQL."""
    spark.udtf.register(name, F.udtf(MailParts))


def parts_of(df: DataFrame, raw: str = "raw", body: str = "text") -> DataFrame:
    """The frame's other columns and a row for each part of its messages."""
    return F.udtf(MailParts)(df.asTable(), body=F.lit(body), raw=F.lit(raw))

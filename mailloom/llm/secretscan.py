"""Secret scans: multipart credentials by interval joins within scopes.

Strong patterns (assignments, access ids, long hex runs) are reported wherever they
stand. Weak candidates - plain user or client ids, unnamed token-like strings,
service addresses - mean nothing alone. They are intervals of three roles (access
identifier, secret, endpoint) that are joined within a scope: the paragraph, and at
most ``reach`` code points between two spans. Each secret is joined with the nearest access
identifier and the nearest endpoint of its scope, each access identifier and endpoint with
the nearest secret. A weak secret is reported with an access identifier, or with an
endpoint that is no plain web address; a weak access identifier with a reported secret; an
endpoint with a reported secret that has an access identifier. The pairs that the join
found come out as links: which access identifier, secret and endpoint make up one
credential. The join looks up each role's sorted intervals, so that its cost is linear in
the candidates of a text but for a logarithm, whatever their number, and as no scope
crosses documents it needs no shuffle.

Null texts count as empty and give no spans. Every input row gives one output row, repeated
rows and null ids too; other columns take no part; an empty table gives no rows. Of spans
equally near the earlier one is joined.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, load

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "link_access", "link_secret", "link_endpoint")
REACH = 300
SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as shorter ones fail
WEAK_ACCESS = re.compile(r"""(?ai:access[_-]?key(?:[_-]?id)?|client[_-]?id|account[_-]?id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{16,}={0,2}")
ENDPOINT = re.compile(r"""(?ai:https?|wss?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]+""")
WEB = re.compile(r"(?ai:https?://)")
SCOPE_END = re.compile(r"\n[\x20\t\r]*\n")
Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """The strong spans of a text by kind, leftmost and non-overlapping within a kind."""
    low = text.lower()
    named = "passw" in low or "secret" in low or "token" in low or "api" in low
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if named else [],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20] if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def _token_like(s: str) -> bool:
    """Letters and some digits, as generated secrets have and words have not; what complements it decides the rest."""
    digits = sum(map(str.isdigit, s))
    return digits >= 3 and any(map(str.isalpha, s))


def _free(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that touch none of taken; both ascend."""
    starts = [s for s, _ in taken]
    reach, top = [], 0
    for _, e in taken:
        top = max(top, e)
        reach.append(top)
    return [x for x in spans if not ((i := bisect_left(starts, x[1])) and reach[i - 1] > x[0])]


class Role:
    """The intervals of one role, to be joined with others by nearness; cuts are the borders of scopes."""

    def __init__(self, spans: list[tuple[str, int, int]], cuts: list[int], reach: int):
        self.spans, self.cuts, self.reach = sorted(spans, key=lambda x: (x[1], x[2], KINDS.index(x[0]))), cuts, reach
        self.starts = [s for _, s, _ in self.spans]
        self.by_end = sorted(range(len(self.spans)), key=lambda i: (self.spans[i][2], -i))
        self.ends = [self.spans[i][2] for i in self.by_end]

    def nearest(self, span: tuple[str, int, int]) -> tuple[str, int, int] | None:
        """The nearest interval apart from a span, within its scope and reach."""
        scope, found = bisect_right(self.cuts, span[1]), []
        i = bisect_right(self.ends, span[1])
        if i:
            found.append(self.spans[self.by_end[i - 1]])
        i = bisect_left(self.starts, span[2])
        if i < len(self.spans):
            found.append(self.spans[i])
        found = [(max(x[1] - span[2], span[1] - x[2]), x[1], x) for x in found if bisect_right(self.cuts, x[1]) == scope]
        return min(found)[2] if found and min(found)[0] <= self.reach else None


def find_credentials(text: str, reach: int = REACH) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """All spans of a text, (kind, start, end) in code points, by start and then by kind; and the links: the access, secret and endpoint span (or None) of each credential."""
    base = base_spans(text)
    out = {(kind, s, e) for kind, spans in base.items() for s, e in spans}
    strong_secret = sorted(base["assign"] + base["hex"])
    taken = sorted(strong_secret + base["access"])
    low = text.lower()
    access = [m.span() for m in WEAK_ACCESS.finditer(text)] if any(w in low for w in ("key", "client", "account", "user", "login")) else []
    endpoint = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    links = []
    if access or endpoint or base["access"]:  # a weak secret is nothing without them
        outside = sorted(taken + access + endpoint)
        named = lambda kind, spans: [(kind, s, e) for s, e in spans]
        weak_secret = named("link_secret", _free([m.span() for m in WEAK_SECRET.finditer(text) if _token_like(m[0])], outside))
        cuts = [m.start() for m in SCOPE_END.finditer(text)]
        accesses = Role(named("access", base["access"]) + named("link_access", _free(access, taken)), cuts, reach)
        endpoints = Role(named("link_endpoint", endpoint), cuts, reach)
        credentials = {}
        for s in named("assign", base["assign"]) + named("hex", base["hex"]) + weak_secret:
            a, e = accesses.nearest(s), endpoints.nearest(s)
            if s[0] != "link_secret" or a or (e and not WEB.match(text, e[1])):
                credentials[s] = a, e
        secrets = Role(list(credentials), cuts, reach)
        found = {(a, s, e if a or s[0] == "link_secret" else None) for s, (a, e) in credentials.items()}
        found |= {(a, s, None) for a in accesses.spans if (s := secrets.nearest(a)) and credentials[s][0] != a}
        found |= {(credentials[s][0], s, e) for e in endpoints.spans if (s := secrets.nearest(e)) and credentials[s][0] and credentials[s][1] != e}
        links = sorted((x for x in found if x[0] or x[2]), key=lambda x: (x[1][1], x[1][2], x[0][1] if x[0] else -1, x[2][1] if x[2] else -1, str(x)))
        out |= {x for link in links for x in link if x}
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2])), links


def find_spans(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    return find_credentials(text, reach)[0]


def _span_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found], kind)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, its spans and its links (places in spans, from 0, of the access identifier, secret and endpoint of a credential; null: none), a row for each input row; texts are scanned whole."""
    parts = ("access", "secret", "endpoint")
    kind = pa.list_(pa.struct([(x, pa.int32()) for x in parts]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, links = [], []
            for t in b.column(1):
                found, linked = find_credentials(t.as_py() or "", reach)
                place = {x: i for i, x in enumerate(found)}
                spans.append(found)
                links.append([{name: place[x] if x else None for name, x in zip(parts, link, strict=True)} for link in linked])
            yield pa.RecordBatch.from_arrays([b.column(0), _span_array(spans), pa.array(links, kind)], ["doc_id", "spans", "links"])

    return doc_rows(docs, id_col, text_col).mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}, links array<struct<access:int,secret:int,endpoint:int>>")


def masked(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with a mark in place of each run of overlapping spans."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """The same rows and columns, with a mark in place of every secret span; a null text stays null."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t and masked(t, find_spans(t, reach), mark) for t in b.column(at).to_pylist()]
            columns = [*b.columns[:at], pa.array(texts, b.column(at).type), *b.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and ``links``: the spans' places, access+secret+endpoint, - for none, comma-joined."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))
    place = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    links = F.array_join(F.transform("links", lambda x: F.concat_ws("+", place(x["access"]), place(x["secret"]), place(x["endpoint"]))), ",")
    return secret_spans(load(spark, sf_dir, "documents")).select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), links.alias("links"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans: the part of operator 1 that SQL can express."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(load(spark, sf_dir, "documents")).select("doc_id", *map(count, BASE_KINDS))


_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
COUNTS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CAST(len([x FOR x IN regexp_extract_all(text, '(?:{_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 6]) AS BIGINT) AS n_assign,
       CAST(len([x FOR x IN regexp_extract_all(text, 'AKIA[A-Z0-9]+') IF length(x) >= 20]) AS BIGINT) AS n_access,
       CAST(len([x FOR x IN regexp_extract_all(text, '[0-9a-f]+') IF length(x) >= 24]) AS BIGINT) AS n_hex
FROM d
"""

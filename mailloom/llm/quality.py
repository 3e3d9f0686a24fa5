"""Quality rules: an ordered decision list that is learned from labelled statistics.

Every text gives a row of counts. On a bounded sample of labelled documents,
sequential covering grows rules for bad documents, one at a time: conditions
``statistic <= or > threshold`` are added by information gain on a growing set,
then dropped again from the end by precision on a pruning set; a rule stays only if it
is precise on both. The documents that a rule covers leave the sets and the next rule is
learned. The list is emitted as an ordered ``CASE WHEN`` of Spark conditions, to be
read and run without Python.

A null text counts as empty: all counts are 0, and the base rule fails it. Every input row
gives one verdict, repeated rows and null ids too, and equal texts have equal ones. An id that
several rows or labels repeat teaches as one document: its largest label, and its least row of
statistics. With no labelled documents, or of one class, there are no rules and only the
base decides. Other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordscan as ws
from .common import doc_rows, labelled_sample, load, with_columns

MAX_LABELLED = 20_000
"""Bound on the labelled documents that rules are learned from."""
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs", "n_digits", "n_pipes", "n_distinct", "n_lines")
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "bangs_per_word": ("n_bangs", "n_words"),
    "digit_share": ("n_digits", "word_chars"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "n_words": ("n_words", None),
}
_CLASS = np.zeros(256, np.uint8)  # bits: symbol, upper case, !, digit, |
for _bit, _bytes in enumerate((b"#*$%&|<>", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!", b"0123456789", b"|")):
    for _b in _bytes:
        _CLASS[_b] |= 1 << _bit
_U = np.uint64


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int32 if len(mask) < 1 << 31 else np.int64)
    np.cumsum(mask, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order, and which of the sorted keys equal the one before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    return order, same


def _in_doc(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return ws.mix(h + docs.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def count_batch(column: pa.Array) -> list[pa.Array]:
    """The COUNTS of a batch of texts."""
    out: list[list[np.ndarray]] = [[] for _ in COUNTS]
    for _, _, w in ws.scan(column, lower=False):
        data, offsets, n = w.data, w.offsets, len(w.offsets) - 1
        kinds = _CLASS[data]
        docs, h = w.docs(), w.hashes()
        chars = _per_doc((data & 0xC0) != 0x80, offsets) - _per_doc(ws._SEP[data], offsets)
        # lines
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        starts = starts[starts < len(data)]
        line_doc = np.searchsorted(offsets, starts, "right") - 1
        next_break = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
        ends = np.minimum(next_break, offsets[line_doc + 1])
        first_word = np.searchsorted(w.starts, starts)
        worded = np.searchsorted(w.starts, ends) > first_word
        starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
        order, same = _repeated(_in_doc(ws.spans_hash(data, starts, ends), line_doc))
        dup_lines = np.bincount(line_doc[order][same], minlength=n)
        # words in repeated windows of three
        wh, at = ws.windows(h, w.ptr, 3)
        order, same = _repeated(_in_doc(wh, docs[at]))
        twice = same.copy()
        twice[:-1] |= same[1:]
        covered = np.zeros(len(h) + 3, bool)
        hit = at[order][twice]
        for k in range(3):
            covered[hit + k] = True
        _, same = _repeated(_in_doc(h, docs))
        distinct = w.counts - np.bincount(docs[_][same], minlength=n)
        rows = [w.counts, chars, _per_doc(kinds & 1, offsets), dup_lines, np.bincount(docs, covered[: len(h)], minlength=n), *(_per_doc((kinds >> b) & 1, offsets) for b in (1, 2, 3, 4)), distinct, np.bincount(line_doc, minlength=n)]
        for column_, x in zip(out, rows, strict=True):
            column_.append(np.asarray(x, np.int64))
    return [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out]


def text_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The same rows and columns, and the COUNTS of the text."""
    return with_columns(docs, text_col, {prefix + c: (pa.int64(), "long") for c in COUNTS}, count_batch)


def ratio(name: str, prefix: str = "") -> Column:
    """A statistic as a Spark expression of the counts; a ratio to nothing is 0."""
    top, bottom = RATIOS[name]
    top = F.col(prefix + top).cast("double")
    return top if bottom is None else F.when(F.col(prefix + bottom) > 0, top / F.col(prefix + bottom)).otherwise(0.0)


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def test(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold

    def column(self, prefix: str) -> Column:
        c = ratio(list(RATIOS)[self.feature], prefix)
        return c > self.threshold if self.above else c <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    """Rules for bad documents, in order; a document that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rejects(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for rule in self.rules:
            out |= covers(rule, x)
        return out

    def kept(self, prefix: str = "") -> Column:
        """CASE WHEN rule 1 THEN false WHEN rule 2 THEN false ... ELSE true END."""
        case = None
        for rule in self.rules:
            test = F.lit(True)
            for c in rule:
                test = test & c.column(prefix)
            case = F.when(test, F.lit(False)) if case is None else case.when(test, F.lit(False))
        return F.lit(True) if case is None else case.otherwise(F.lit(True))

    def __str__(self) -> str:
        names = list(RATIOS)
        return "\n".join(" and ".join(f"{names[c.feature]} {'>' if c.above else '<='} {c.threshold:.4g}" for c in rule) + " -> reject" for rule in self.rules) + "\notherwise -> keep"


def covers(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.test(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int, steps: int) -> tuple[Condition, ...]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    for _ in range(most):
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if p == 0 or n == 0:
            break
        before, best, choice = np.log2(p / (p + n)), (1e-9, 0.0), None
        y = bad[inside]
        for f in range(x.shape[1]):
            v = x[inside, f]
            values = np.unique(np.concatenate([np.quantile(v, np.linspace(0.01, 0.99, steps)), np.quantile(v[y], np.linspace(0, 1, steps)), np.quantile(v[~y], np.linspace(0, 1, steps))]))
            order = np.argsort(v, kind="stable")
            ranked, spread = v[order], v.std() + 1e-12
            at = np.searchsorted(ranked, values, "right")
            bad_to = np.concatenate([[0], np.cumsum(y[order])])[at]
            # each threshold stands in the middle of the gap that it lies in; of equal gains the widest gap wins
            low, high = ranked[np.maximum(at - 1, 0)], ranked[np.minimum(at, len(v) - 1)]
            margin = np.where((at > 0) & (at < len(v)), (high - low) / spread, 0.0)
            for above, pp, tt in ((False, bad_to, at), (True, p - bad_to, len(v) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / np.maximum(tt, 1)) - before), -1)
                k = max(range(len(values)), key=lambda k: (round(gain[k], 6), margin[k]))
                if (round(gain[k], 6), margin[k]) > best:
                    best, choice = (round(gain[k], 6), margin[k]), Condition(f, above, float(low[k] + high[k]) / 2 if margin[k] else float(values[k]))
        if choice is None:
            break
        rule.append(choice)
        inside &= choice.test(x)
    return tuple(rule)


def _prune(rule: tuple[Condition, ...], x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    def worth(r: tuple[Condition, ...]) -> float:
        c = covers(r, x)
        p, n = bad[c].sum(), (~bad[c]).sum()
        return (p - n) / max(1, p + n)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 11, precision: float = 0.97, least: int = 4, max_rules: int = 12, max_conditions: int = 4, steps: int = 40) -> DecisionList:
    """Sequential covering over statistics x (columns as in RATIOS) with labels bad."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rules = []
    while len(rules) < max_rules and bad.sum() >= least and (~bad).any():
        grow = rng.random(len(x)) < 2 / 3
        rule = _grow(x[grow], bad[grow], max_conditions, steps) if bad[grow].any() else ()
        if (~grow).any() and bad[~grow].any():
            rule = _prune(rule, x[~grow], bad[~grow])
        c = covers(rule, x)
        held = c & ~grow
        if not rule or bad[c].sum() < least or bad[c].mean() < precision or (held.any() and bad[held].mean() < precision - 0.05):
            break
        rules.append(rule)
        x, bad = x[~c], bad[~c]
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learns from a bounded sample of the labelled documents; documents that the base rule fails anyway teach nothing."""
    sample = labelled_sample(labels, "quality", max_labelled)
    rows = text_counts(doc_rows(docs).join(F.broadcast(sample), "doc_id"))
    row = F.struct("label", *(ratio(r).alias(f"r{i}") for i, r in enumerate(RATIOS)))
    rows = rows.filter(~base_failed()).groupBy("doc_id").agg(F.min(row).alias("x")).select("x.*").toPandas()  # one for each id of the sample
    if not len(rows):
        return DecisionList()
    rows = rows.sort_values(list(rows.columns))
    return learn(rows.drop(columns="label").to_numpy(float), rows["label"].to_numpy() == 0)


def quality_verdicts(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the COUNTS, base_failed and kept, a row for each input row."""
    rows = text_counts(doc_rows(docs, id_col, text_col)).withColumn("base_failed", base_failed())
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & rules.kept()).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The documents that neither the base nor a rule rejects, with their own columns only."""
    p = "__mailloom_"
    return text_counts(docs, text_col, p).filter(~base_failed(p) & rules.kept(p)).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    rules = fit(docs, load(spark, sf_dir, "labels"))
    return quality_verdicts(docs, rules)


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the base rule needs, without the learned rules: the part of operator 6 that SQL can express."""
    rows = quality_verdicts(load(spark, sf_dir, "documents"), DecisionList())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


COUNTS_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
g AS (
  SELECT doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g, unnest(range(1, len(w) - 1)) AS i
  FROM w WHERE len(w) > 2),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
k AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) x(o) GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words
  FROM w LEFT JOIN k USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""

"""Entities by a table of names: an Aho-Corasick automaton, the leftmost longest name at word borders.

A text is read once, whatever the number of names. Every name that ends at a place and stands between word
borders is a candidate; of these the leftmost is taken, of several there the longest, and
the search goes on behind it. The automaton is made once in each worker from the broadcast names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_NAMES = 500_000
"""The names that workers are given; a table with more is refused."""
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType())]))


def folded(s: str) -> str:
    """Lower case, character by character, so that places stay."""
    return "".join(c if len(x := c.lower()) != 1 else x for c in s)


def _inside(s: str, i: int) -> bool:
    """Whether the characters around a place belong to one word."""
    return 0 < i < len(s) and all(c.isalnum() or c == "_" for c in s[i - 1 : i + 1])


class Gazetteer:
    """Spans (start, end, label) of the names in texts. Of a name that is given twice the first label holds."""

    def __init__(self, names: Iterable[tuple[str, str]], fold: bool = False):
        import ahocorasick

        self.fold, self.automaton = fold, ahocorasick.Automaton()
        for name, label in names:
            name = folded(name) if fold else name
            if name and name not in self.automaton:
                self.automaton.add_word(name, (len(name), label))
        if len(self.automaton):
            self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        if not len(self.automaton) or not text:
            return []
        text, found = folded(text) if self.fold else text, {}
        for last, (n, label) in self.automaton.iter(text):
            start = last + 1 - n
            if not (_inside(text, start) or _inside(text, last + 1)) and n > found.get(start, (0,))[0]:
                found[start] = (n, label)
        out, free = [], 0
        for start in sorted(found):
            if start >= free:
                n, label = found[start]
                out.append((start, start + n, label))
                free = start + n
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        return [self.spans(t or "") for t in texts]


def names_of(table: DataFrame, name: str = "name", label: str = "label", most: int = MOST_NAMES) -> list[tuple[str, str]]:
    """The table's names and labels, each name once with its least label; more than ``most`` are an error."""
    rows = table.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("n")).agg(F.min(label).alias("l")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names")
    return [(r["n"], r["l"]) for r in rows]


class Tagger:
    """A tagger for :func:`mailloom.functions.masking.entity_masker`; small when it is sent, made whole where it is first used."""

    def __init__(self, table: DataFrame, fold: bool = False, **columns: str):
        self.names, self.fold, self.made = table.sparkSession.sparkContext.broadcast(names_of(table, **columns)), fold, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        if self.made is None:
            self.made = Gazetteer(self.names.value, self.fold)
        return self.made(texts)


def entities(df: DataFrame, tagger: Tagger, body: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, end, label: a row for every name in a text; a null text has none."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([[{"start": a, "end": b, "label": x} for a, b, x in spans] for spans in tagger(texts.tolist())], dtype=object)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.select(key, F.inline(F.pandas_udf(run, SPAN)(F.col(body))))

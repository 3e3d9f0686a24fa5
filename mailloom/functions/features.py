"""Features of a message: addresses, links, fingerprints, language."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip, text

# What a link looks like in text, and what may not end it.
URL = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"
URL_TAIL = ".,;)>'\"]"
# Frequent words of the languages that are told apart.
STOP_WORDS = {
    "en": "the of and to in is that for it with as was on be by this are at from or".split(),
    "fr": "le la les de des et un une que qui dans pour pas sur est en du au ou par".split(),
    "de": "der die das und ist in den von zu mit dem des auf nicht ein eine als auch es für".split(),
    "es": "el la los las de que y en un una por con para no es del se su al lo".split(),
}
LANGUAGE_CHARS, LANGUAGE_LEAST = 1000, 15


def address(header: Column) -> Column:
    """The bare address of a header, in lower case; empty without one."""
    inside = F.regexp_extract(text(header), r"<([^<>]*)>", 1)
    bare = F.when(text(header).contains("<"), inside).otherwise(text(header))
    bare = F.lower(strip(bare))
    return F.when(bare.contains("@"), bare).otherwise("")


def address_hash(header: Column) -> Column:
    a = address(header)
    return F.when(a == "", "").otherwise(F.sha2(a, 256))


def address_domain(header: Column) -> Column:
    a = address(header)
    return F.when(a == "", "").otherwise(strip(F.element_at(F.split(a, "@"), -1)))


def urls(plain: Column, html: Column | None = None) -> Column:
    """Distinct links, sorted: from the text, and from link targets of markup that stand in any quotes or none."""
    both = F.concat(text(html), F.lit("\n"), text(plain)) if html is not None else text(plain)
    found = F.transform(F.regexp_extract_all(both, F.lit("(?i)" + URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;)>'\"\]]+\z", ""))
    if html is not None:
        targets = F.regexp_extract_all(text(html), F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*((?-i:https?://|www\.)[^\s"'>]*)"""), F.lit(1))
        found = F.concat(found, targets)
    return F.array_sort(F.array_distinct(F.filter(found, lambda u: u != "")))


def urls_in(s: str | None) -> list[str]:
    """The same of one plain text, in Python."""
    return sorted({u for m in re.finditer("(?i)" + URL, s or "") if (u := m[0].rstrip(".,;)>'\"]"))})


def url_numbers(links: list[str]) -> dict[str, int | float]:
    """The metrics of one message's links, in Python."""
    lengths, depths = [len(u) for u in links], []
    for u in links:
        host = re.match(r"(?:https?://)?(?:[^/?#@]*@)?([^/?#:]*)", u)[1].lower()
        depths.append(0 if re.fullmatch(r"[0-9]*", host.replace(".", "")) else max(0, host.count(".") - 1))
    mean = lambda x: math.floor(100 * sum(x) / len(x) + 0.5) / 100 if x else 0.0
    return {"url_count": len(links), "url_length_max": max(lengths, default=0), "url_length_avg": mean(lengths), "url_subdom_max": max(depths, default=0), "url_subdom_avg": mean(depths)}


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:https?://)?(?:[^/?#@]*@)?([^/?#:]*)", 1))


def subdomains(url: Column) -> Column:
    """Labels before the last two of a host; none in an address of digits."""
    host = hostname(url)
    labels = F.size(F.split(host, r"\."))
    return F.when(F.replace(host, F.lit("."), F.lit("")).rlike(r"^\d*$"), 0).otherwise(F.greatest(labels - 2, F.lit(0))).cast("int")


def url_metrics(found: Column) -> dict[str, Column]:
    """Count, longest and mean length, deepest and mean number of subdomains; zeros without links."""
    n = F.size(found)
    lengths, depths = F.transform(found, F.length), F.transform(found, subdomains)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    mean = lambda a: F.when(n > 0, F.round(total(a) / n, 2)).otherwise(0.0)
    top = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    return {"url_count": n, "url_length_max": top(lengths), "url_length_avg": mean(lengths), "url_subdom_max": top(depths), "url_subdom_avg": mean(depths)}


def fingerprint(subject: Column, body: Column) -> Column:
    return F.md5(F.concat(text(subject), text(body)))


def model_hash(name: str, modulus: int = 10_000) -> int:
    return int(hashlib.md5(name.encode()).hexdigest(), 16) % modulus


def model_hash_column(name: Column) -> Column:
    """The md5 of a name as a number, modulo 10,000: its last digits suffice, as 16**k is 0 modulo 10,000 but for the rest modulo 625."""
    digest = F.md5(name)
    out = F.lit(0)
    for k in range(4):
        part = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")
        out = (out * F.lit(pow(16, 8, 10_000)) + part) % 10_000
    return out.cast("int")


def guess_language(s: str | None) -> str:
    """Of a text's first characters, the language with the most of its frequent words; unknown if it is too short."""
    s = (s or "").strip()
    if len(s) < LANGUAGE_LEAST:
        return "unknown"
    words = Counter(s[:LANGUAGE_CHARS].lower().split())
    score = {lang: sum(words[w] for w in stop) for lang, stop in STOP_WORDS.items()}
    best = max(score, key=score.get)
    return best if score[best] else "en"


@F.pandas_udf(T.StringType())
def language(s: pd.Series) -> pd.Series:
    return s.map(guess_language)


def language_native(body: Column) -> Column:
    """The same decision on built-in functions."""
    s = strip(text(body))
    words = F.split(F.lower(F.substring(s, 1, LANGUAGE_CHARS)), r"\s+")
    hits = lambda stop: F.size(F.filter(words, lambda w: w.isin(stop)))
    scores = [F.struct(hits(stop).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, stop) in enumerate(STOP_WORDS.items())]
    best = F.greatest(*scores)
    return F.when(F.length(s) < LANGUAGE_LEAST, "unknown").when(best["n"] > 0, best["lang"]).otherwise("en")

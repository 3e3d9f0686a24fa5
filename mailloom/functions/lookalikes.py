"""Unicode normalisation: compatibility forms, invisible characters, look-alike letters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Which ASCII letters stand in for look-alike characters, by code point.
LOOKALIKES = {
    "ɑ": "a", "ɒ": "o", "ɔ": "c", "ɡ": "g", "ɩ": "i", "ɴ": "N", "ɵ": "o", "ʀ": "R", "ʏ": "Y", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "Ϲ": "C",
    "Ё": "E", "Ѕ": "S", "І": "I", "Ј": "J", "Ў": "U", "А": "A", "Б": "B", "В": "B", "Г": "F", "Д": "D", "Е": "E", "Ж": "ZH",
    "З": "3", "И": "N", "Й": "Y", "К": "K", "Л": "L", "М": "M", "Н": "H", "О": "O", "П": "N", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Ф": "F", "Х": "X", "Ц": "C", "Ч": "CH", "Ш": "W", "Щ": "W", "Ъ": "b", "Ы": "bl", "Ь": "b", "Э": "E", "Ю": "IO",
    "Я": "R", "а": "a", "б": "b", "в": "v", "г": "r", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "u", "й": "i", "к": "k",
    "л": "l", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "ф": "f", "х": "x", "ц": "c",
    "ч": "h", "ш": "w", "щ": "w", "ъ": "b", "ы": "bl", "ь": "b", "э": "e", "ю": "io", "я": "r", "ё": "e", "ѕ": "s", "і": "i",
    "ј": "j", "ў": "u", "һ": "h", "ԁ": "d", "ԛ": "q", "Ԝ": "W", "ԝ": "w", "Ա": "A", "Բ": "B", "Գ": "G", "Դ": "D", "Ե": "E",
    "Զ": "Z", "Է": "E", "Ը": "E", "Թ": "T", "Ժ": "Z", "Ի": "I", "Լ": "L", "Խ": "X", "Ծ": "C", "Կ": "K", "Հ": "H", "Ձ": "D",
    "Ղ": "G", "Ճ": "C", "Մ": "M", "Յ": "Y", "Ն": "N", "Շ": "S", "Ո": "O", "Չ": "C", "Պ": "P", "Ջ": "J", "Ռ": "R", "Ս": "S",
    "Վ": "V", "Տ": "T", "Ր": "R", "Ց": "C", "Ւ": "U", "Փ": "P", "Ք": "K", "Օ": "O", "Ֆ": "F", "ա": "a", "բ": "b", "գ": "g",
    "դ": "d", "ե": "e", "զ": "z", "է": "e", "ը": "e", "թ": "t", "ժ": "z", "ի": "i", "լ": "l", "խ": "x", "ծ": "c", "կ": "k",
    "հ": "h", "ձ": "d", "ղ": "g", "ճ": "c", "մ": "m", "յ": "y", "ն": "n", "շ": "s", "ո": "n", "չ": "c", "պ": "u", "ջ": "j",
    "ռ": "r", "ս": "u", "վ": "v", "տ": "t", "ր": "r", "ց": "c", "ւ": "u", "փ": "p", "ք": "k", "օ": "o", "ֆ": "f", "֌": "l",
    "֎": "u", "Ꭰ": "T", "Ꭱ": "A", "Ꭴ": "y", "Ꭵ": "E", "Ꭹ": "H", "Ꭻ": "M", "Ꮍ": "Y", "Ꮗ": "Z", "Ꮞ": "S", "Ꮟ": "b", "Ꮥ": "W",
}


def lookalikes() -> dict[str, str]:
    """Character to its ASCII stand-in of one or two letters."""
    return LOOKALIKES


def replace_lookalikes(c: Column) -> Column:
    """Look-alike letters as ASCII: one ``translate`` for single letters, a replacement for each pair."""
    table = lookalikes()
    single = {k: v for k, v in table.items() if len(v) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in table.items():
        if len(v) > 1:
            c = F.replace(c, F.lit(k), F.lit(v))
    return c


def drop_invisible(c: Column) -> Column:
    """Without format characters (zero-width, direction marks)."""
    return F.regexp_replace(c, r"\p{Cf}", "")


def normal_text(s: str | None) -> str:
    """The whole normalisation of one text; letters of the two alphabets that have no stand-in take the first letter of their Unicode name."""
    if not s:
        return ""
    if s.isascii():
        return s
    s = unicodedata.normalize("NFKC", s)
    made = {ch: new for ch in set(s) if not ch.isascii() and (new := _made(ch)) != ch}
    return s.translate(str.maketrans(made)) if made else s


@lru_cache(1 << 16)
def _made(ch: str) -> str:
    """What one normalised character becomes."""
    if unicodedata.category(ch) == "Cf":
        return ""
    new = lookalikes().get(ch, ch)
    return _named(ch) if new == ch and "\u0400" <= ch <= "\u058f" else new


def _named(ch: str) -> str:
    name = unicodedata.name(ch, "")
    if "LETTER" not in name:
        return " "
    letter = name.split()[-1][0]
    return letter.lower() if "SMALL" in name else letter.upper()


@F.pandas_udf(T.StringType())
def normalise_unicode(s: pd.Series) -> pd.Series:
    return s.map(normal_text)


@F.pandas_udf(T.StructType([T.StructField("given", T.StringType()), T.StructField("normal", T.StringType())]))
def with_normal(s: pd.Series) -> pd.DataFrame:
    """A text as it came and normalised: what it is made of is worked out for this function alone, where Spark would do so again for each other use."""
    return pd.DataFrame({"given": s, "normal": s.map(normal_text)})

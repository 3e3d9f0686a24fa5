"""Languages by n-grams, names by a gazetteer and overlapping intervals, against brute force."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from mailloom.functions import gazetteer
from mailloom.functions import masking as mk
from mailloom.operators import intervals, language

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark, tmp_path):
    """Rows that were not learned from are told apart, language by language; short, empty and null texts are unknown; a saved model gives the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.filter("doc_id % 3 <> 1"))
    held = docs.filter("doc_id % 3 = 1 and length(trim(text)) >= 15")
    right = {r["lang"]: (r["ok"], r["n"]) for r in language.detect(held, model).join(docs, "doc_id").groupBy("lang").agg(F.count_if(F.col("lang") == F.col("language")).alias("ok"), F.count("*").alias("n")).collect() if r["lang"]}
    assert len(right) == 4 and all(ok >= 0.9 * n for ok, n in right.values()), right
    model.save(str(tmp_path / "m"))
    few = spark.createDataFrame([(1, "short"), (2, None), (3, ""), (4, "the of and to in is that for it"), (5, "  \n "), (6, "x" * 3000)], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["language"] for r in language.detect(few, m).collect()} for m in (model, language.LanguageModel.load(spark, str(tmp_path / "m"))))
    assert a == b and [a[k] for k in (1, 2, 3, 4, 5)] == ["unknown"] * 3 + ["en", "unknown"] and len(a) == 6
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs.limit(0))


def brute_spans(text, names):
    """Leftmost longest at word borders, place by place."""
    word = lambda c: c.isalnum() or c == "_"
    inside = lambda i: 0 < i < len(text) and word(text[i - 1]) and word(text[i])
    out, i = [], 0
    while i < len(text):
        fits = [(len(n), x) for n, x in names if text.startswith(n, i) and not inside(i) and not inside(i + len(n))]
        if fits:
            n, label = max(fits, key=lambda f: f[0])
            out.append((i, i + n, label))
            i += n
        else:
            i += 1
    return out


def test_gazetteer(spark):
    r = random.Random(4)
    parts = ["Ann", "Ann Lee", "Lee", "Lee Roy Day", "Acme", "Acme (Ltd.)", "Zoë", "New York", "York", "a", "X-1"]
    names = [(p, r.choice(["PERSON", "ORG", "GPE"])) for p in parts]
    tagger = gazetteer.Gazetteer(names)
    for _ in range(500):
        t = "".join(r.choice([*parts, " ", " ", ".", "s", "_", "'", "\n", "日"]) for _ in range(r.randrange(40)))
        assert tagger.spans(t) == brute_spans(t, names), t
    assert gazetteer.Gazetteer([("İstanbul Ave", "GPE"), ("ann", "PERSON")], fold=True).spans("at İSTANBUL ave: ANN") == [(3, 15, "GPE"), (17, 20, "PERSON")]
    assert gazetteer.Gazetteer([])(["x", None]) == [[], []]
    table = spark.createDataFrame([*names, ("Ann", "ZZZ"), (None, "ORG")], "name string, label string")
    df = spark.createDataFrame([(1, "Ann Lee of Acme", "to Zoë [NAME]"), (2, None, None)], "doc_id long, subject string, body string")
    one = gazetteer.Tagger(table)
    out = df.select("doc_id", mk.entity_masker(one)("subject", "body").alias("m")).select("doc_id", "m.*").orderBy("doc_id").collect()
    want = [mk.replace_entities(t, brute_spans(t, names)) for t in ("Ann Lee of Acme", "to Zoë [NAME]")]
    assert [out[0]["subject"], out[0]["body"], out[1]["subject"], out[1]["body"]] == [*want, "", ""]
    assert [tuple(x) for x in gazetteer.entities(df, one, "subject").collect()] == [(1, a, b, x) for a, b, x in brute_spans("Ann Lee of Acme", names)]
    with pytest.raises(ValueError, match="names"):
        gazetteer.names_of(table, most=3)


def test_gazetteer_is_linear():
    """50,000 names over a text of a million characters, in seconds."""
    r = random.Random(1)
    names = [("".join(r.choices("abcdefghij", k=r.randrange(4, 9))).title(), "ORG") for _ in range(50_000)]
    tagger, text = gazetteer.Gazetteer(names), " ".join(r.choice(names)[0] if r.random() < 0.2 else "filler" for _ in range(150_000))
    begun = time.perf_counter()
    found, known = tagger.spans(text), {n for n, _ in names}
    assert time.perf_counter() - begun < 20 and len(found) == sum(w in known for w in re.findall(r"\w+", text))


def spans(r, n, side):
    for i in range(n):
        a = r.choice([r.randrange(-50, 50), r.randrange(10_000), 0])
        yield (i, r.choice(["x", "y", None]) if i % 5 == 0 else "x", a, a + r.choice([0, 1, 2, r.randrange(1, 60), r.randrange(1, 9000), -3]) if i % 11 else None)


@pytest.mark.parametrize("crowded", [4, 4096])
def test_intervals(spark, crowded):
    r = random.Random(2)
    left, right = list(spans(r, 300, "l")), list(spans(r, 250, "r"))
    l = spark.createDataFrame(left, "i long, k string, start long, end long")  # noqa: E741
    q = spark.createDataFrame(right, "j long, k string, c long, d long")
    df = intervals.overlapping(l, q, ["k"], right_start="c", right_end="d", crowded=crowded)
    got = sorted((x["i"], x["j"]) for x in df.collect())
    ok = lambda s: s[1] is not None and s[3] is not None and s[2] < s[3]
    want = sorted((a[0], b[0]) for a in left for b in right if ok(a) and ok(b) and a[1] == b[1] and a[2] < b[3] and b[2] < a[3])
    assert got == want and len(want) > 1000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError, match="both sides"):
        intervals.overlapping(l, l, ["k"])

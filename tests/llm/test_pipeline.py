"""The corpus pipeline stage by stage, against plain Python."""

import pytest

import corpus_pipeline as cp
from mailloom.llm import quality, secretscan, toxicity
from mailloom.llm.common import load, stored

from .test_llm import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = load(spark, SF, "documents")
    out = {"": docs}
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def test_columns(stages):
    names = [n for n, _ in cp.STAGES]
    assert all(stages[n].columns == stages[""].columns for n in names[:-1])


def test_filters(spark, stages):
    rules = quality.fit(stages[""], load(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality.quality_verdicts(stages[""], rules).filter("kept").collect()}
    assert {r["doc_id"] for r in stages["quality"].collect()} == good
    model = toxicity.fit(stages["quality"], load(spark, SF, "labels"))
    clean = {r["doc_id"] for r in toxicity.score_toxicity(stages["quality"], model).filter("score < 0.7").collect()}
    assert {r["doc_id"] for r in stages["toxicity"].collect()} == clean


def test_one_of_each_group(stages):
    texts = {r["doc_id"]: r["text"] for r in stages["toxicity"].collect()}
    want = {root for _, root in brute_components(texts, cp.PERCENT, cp.SHINGLE).values()}
    assert {r["doc_id"] for r in stages["jaccard"].collect()} == want


def test_repeated_rows(spark, stages):
    docs = stages["toxicity"].limit(20)
    twice = docs.unionByName(docs)
    assert cp.jaccard_stage(spark, twice, SF).count() == cp.jaccard_stage(spark, docs, SF).count()


def test_redacted_and_packed(stages):
    assert all(not secretscan.find_spans(r["text"]) for r in stages["secrets"].collect())
    packed = stages["packing"].groupBy("doc_id").sum("length").count()
    assert packed == stages["secrets"].count()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"
"""Documents, and columns whose names the operators use too."""


def words(seed, n=80):
    r = __import__("random").Random(seed)
    return " ".join(f"{r.choice('bdfgklmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", " \n", "one", words(1), words(1), words(2), words(3), words(3) + " more", words(4, 6000), "z" * 20_000, words(5) + " password=hunter2222"]
    rows = [(i, t, "en", "src0", len(t or ""), 0.5, "no") for i, t in enumerate(texts)]
    rows += [(4, words(1), "en", "src0", 1, 0.5, "no"), (6, words(7), None, None, None, None, None), (None, words(2), None, None, None, None, None), (None, words(8), None, None, None, None, None), (None, words(9), None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.mark.parametrize("stage", range(5))
def test_awkward_rows(spark, awkward, stage):
    name, run = cp.STAGES[stage]
    got = run(spark, awkward, SF)
    rows = [tuple(r) for r in got.collect()]
    empty = run(spark, awkward.limit(0), SF)
    assert empty.count() == 0 and empty.columns == got.columns
    if name == "packing":
        assert len({r["sequence_id"] for r in got.collect()}) > 1 and got.filter("start = 0").count() == awkward.count()
        return
    assert got.columns == awkward.columns and got.schema.simpleString() == awkward.schema.simpleString()
    by = [(r[0], r[1]) for r in rows]
    if name == "quality":
        assert all(t and len(t.split()) >= 50 for _, t in by) and (None, words(8)) in by and by.count((4, words(1))) == 2
    if name == "toxicity":
        assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in awkward.collect())
    if name == "jaccard":
        want = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, words(1)), (6, words(2)), (7, words(3)), (9, words(4, 6000)), (10, "z" * 20_000), (11, words(5) + " password=hunter2222"), (6, words(7)), (None, words(8)), (None, words(9)), (None, None)]
        assert sorted(by, key=str) == sorted(want, key=str)
    if name == "secrets":
        assert len(rows) == awkward.count() and all(r[4] == (None if r[1] is None else len(r[1])) for r in rows)
        assert (11, words(5) + " [SECRET]") in by


def test_stored_tables_are_removed(spark):
    from mailloom.llm import common

    common.stored(spark.range(3), "some")
    path = common._written[-1]
    assert common.remove_stored(spark) > 0 and not common._written
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

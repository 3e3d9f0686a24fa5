"""Findings of the third review that were open after its round."""

import numpy as np

from mailloom.operators import latent, tfidf

TEXTS = [(i, " ".join(f"w{i * k % 13}" for k in range(1, 3 + i % 5)), i % 3) for i in range(40)] + [(40, None, 0), (41, "", 0), (42, "?", 0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fitted_blocks_move_no_rows(spark):
    """vectors are made where the texts are, without an attribute for each place, and equal those of the joined way."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, other int")
    style = tfidf.Stylometric().fit(df)
    out = style.transform(df)
    assert "Exchange" not in _plan(out)
    assert not out.schema["stylo"].metadata
    assert out.columns == ["doc_id", "text", "other", "stylo"]
    got = {r["doc_id"]: r["stylo"].toArray() for r in out.collect()}
    want = [{r["doc_id"]: r["v"].toArray() for r in style.blocks[kind]._joined(df, "text", "v", "doc_id").collect()} for kind in ("word", "char")]
    assert len(got) == len(TEXTS)
    for i, v in got.items():
        assert np.allclose(v, np.concatenate([w[i] for w in want]), rtol=0, atol=1e-12)


def test_product_adds_slices(spark, monkeypatch):
    """the block of a pass is added up slice by slice, whatever the slices, and no task holds more than one slice of each part."""
    monkeypatch.setattr(latent, "SLICE", 7)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, other int")
    style = tfidf.Stylometric().fit(df)
    rows = style.transform(df).select("stylo").repartition(5)
    x = np.array([r["stylo"].toArray() for r in rows.collect()], np.float32).astype(float)
    z = np.random.default_rng(1).standard_normal((x.shape[1], 3))
    assert np.allclose(latent.table_product(rows, z), x.T @ (x @ z), atol=1e-9)


def test_sums_side_by_side_are_exact():
    """op2: products, squares and the query's squares counted as one number, and apart where they do not fit."""
    from mailloom.llm.topk import Sums

    rng = np.random.default_rng(5)
    for high, joint in ((32, True), (1 << 14, False)):
        x, q = rng.integers(-high, high, (50, 16)).astype(float), rng.integers(-high, high, 16).astype(float)
        norm = (x * x).sum(1)
        sums = Sums(50, float(norm.max()), float(q @ q))
        assert sums.joint is joint
        for j in range(0, 16, 4):
            who = np.tile(np.arange(50), 4)
            score, squares, weights = sums.add(who, x[:, j : j + 4].T.ravel().copy(), q[j : j + 4], np.full(4, 50))
            done = j + 4
            assert (score == x[:, :done] @ q[:done]).all() and (squares == (x[:, :done] ** 2).sum(1)).all() and (weights == (q[:done] ** 2).sum()).all()


def test_machine_takes_short_words_whole():
    """op10: a word that is handed over whole, one byte by byte, and one beyond the limit give the same ids."""
    from mailloom.llm import bpe
    from mailloom.llm.common import word_bpe_path

    enc = bpe.encoder(word_bpe_path())
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 47, 48, 49, 300, enc.lookahead + enc.longest + 3 * bpe.WINDOW):
        word = bytes(rng.integers(97, 123, n).tolist())
        whole, single = bpe.Transducer(enc), bpe.Transducer(enc)
        one = whole.feed(word) + whole.finish()
        many = [i for b in word for i in single.feed(bytes([b]))] + single.finish()
        assert one == many
        assert bpe.packed(one) == np.array(one, "<u4").tobytes()
        assert len(whole.held) == 0 and whole.byte == -1


def test_weights_move_no_row_for_a_term(spark):
    """weights of repeated, null and empty texts and a null key are those of the joined way; what is shuffled are texts and packed terms."""
    df = spark.createDataFrame([*TEXTS, (None, "w1 w2 w1", 0), (7, "more of the same w1", 0), (50, "é ü w1 " * 30, 0)], "doc_id long, text string, other int").repartition(3)
    counts = tfidf.term_counts(df, tfidf.pieces("word", df["text"]), "word")
    want = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf.weights(counts, tfidf.document_counts(df, tfidf.pieces("word", df["text"]), "word"), 46).collect()}
    out = tfidf.chunk_weights(df, "text", 46, "word")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in out.collect()}
    assert out.columns == ["doc_id", "term", "weight"] and len(want) > 250
    assert got.keys() == want.keys() and all(abs(w - want[k]) < 1e-12 for k, w in got.items())
    assert out.count() == len(want)
    assert "hashpartitioning(term" not in _plan(out)
    assert tfidf.chunk_weights(df.limit(0), "text", 0, "word").count() == 0


def test_log_probs_by_class():
    """op4: what is gathered by class equals each symbol's own softmax, with and without words of the head; probabilities add up to one."""
    from mailloom.llm import recurrent as rc

    rng = np.random.default_rng(4)
    head = np.append(np.arange(1, 40, dtype=np.uint64), rc.END)
    counts = np.arange(40, 0, -1)
    lex = rc.Lexicon(np.sort(head), counts, np.arange(40), head, counts, np.full(rc.TAIL_CLASSES, 5.0), np.full(rc.TAIL_CLASSES, 2.0), 2000, 200, 0.5)
    net = rc.Network(lex)
    net.p = {k: (v + rng.normal(0, 0.3, v.shape) * (v > -1e3)).astype(np.float32) for k, v in net.p.items()}
    h = rng.normal(0, 1, (1, rc.HIDDEN)).astype(np.float32)
    every = np.arange(net.k + rc.TAIL_CLASSES, dtype=np.int16)
    got = net.log_probs(np.repeat(h, len(every), 0), every)
    assert abs(np.exp(got).sum() - 1) < 1e-4
    assert np.allclose([net.log_probs(h, every[i : i + 1])[0] for i in range(len(every))], got, atol=1e-4)
    assert np.allclose(net.log_probs(np.repeat(h, 3, 0), every[-3:]), got[-3:], atol=1e-4)
    assert rc.WINDOW * (rc.CLASSES + rc.TAIL_CLASSES) * 4 <= 1 << 21  # outputs of a window stay in the cache

"""The operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mailloom.llm import bpe, chat, common, jaccard, packing, quality, recurrent, secretscan, tokencount, topk, toxicity
from mailloom.llm import wordscan as ws

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [None, "", " \n\t", "x", "a b c", "é ü 日本 🙂", "a b\na b\n\na b", "\x00 \x0b\x0c", "word " * 3000, "z" * 50_000, "<|endoftext|> it's ''s 12 3"]


def frame(spark, texts, start=0):
    """Documents with ids, a column whose name may clash, and repeated rows and texts."""
    rows = [(start + i, t, "en", "src0", 0, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id text here", None, None, None, None)], "doc_id long, text string, lang string, source string, n_words int, score double")


def prose(seed, n, vocabulary=200):
    r = random.Random(seed)
    words = [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiou')}{r.choice('lmnrst')}{k}" for k in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, AWKWARD + [prose(1, 120), prose(1, 120)]).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []).limit(0)


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


# ---- words ---------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_words(monkeypatch, piece):
    monkeypatch.setattr(ws, "SLICE", piece)
    monkeypatch.setattr(ws, "_powers", None)
    got, seen = [], {}
    for i, j, w in ws.scan(pa.array(AWKWARD), lower=False):
        for k in range(j - i):
            got.append([bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.ptr[k] : w.ptr[k + 1]], w.ends[w.ptr[k] : w.ptr[k + 1]], strict=True)])
        for a, b, h in zip(w.starts, w.ends, w.hashes(), strict=True):
            assert seen.setdefault(bytes(w.data[a:b]), h) == h
    assert got == [WORD.findall(t or "") for t in AWKWARD]
    assert len(set(seen.values())) == len(seen)


# ---- 1 ---------------------------------------------------------------------------


def brute_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        out += [("assign", *m.span())] * (len(m[2]) >= 6)
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]


SECRETS = [
    "password=short secret=token : abcdefgh API_KEY: 'abcdef123'",
    "AKIA" + "A1" * 8 + " then " + "0123456789abcdef" * 2,
    "ſecret=abcdefgh Secret = \"x1y2z3w4\" tokentoken=aaaaaa",
    "user: bob\nnothing",
    "client_id: abc-1 9f8Kd02LmQ7xWv4Tz1Bn and https://api.example.org/v1",
    "9f8Kd02LmQ7xWv4Tz1Bn alone",
    "https://a.b alone",
    "user: bob" + "\n\n" + "9f8Kd02LmQ7xWv4Tz1Bn",
    "9f8Kd02LmQ7xWv4Tz1Bn see https://a.b",
    "key d41d8cd9-8f00-b204-e980-0998ecf8427e at postgres://db.host/x",
    "login=ann key1abcdefghij234567 and login=eve " + "k" * 400 + " 77aabbccddeeff0011223344 user=max",
]


def brute_links(text, reach=secretscan.REACH):
    """Every pair of a secret with the nearest part of another role in its paragraph, by comparing all with all."""
    spans, links = secretscan.find_credentials(text, reach)
    cuts = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda x: sum(c <= x[1] for c in cuts)
    gap = lambda x, y: max(y[1] - x[2], x[1] - y[2])
    by = lambda *kinds: [x for x in spans if x[0] in kinds]
    near = lambda x, others: min(((gap(x, y), y[1], y) for y in others if scope(y) == scope(x) and 0 <= gap(x, y) <= reach), default=(0, 0, None))[2]
    accesses, secrets = by("access", "link_access"), by("assign", "hex", "link_secret")
    want = {(near(s, accesses), s) for s in secrets if near(s, accesses)} | {(a, near(a, secrets)) for a in accesses if near(a, secrets)}
    return want, {(a, s) for a, s, _ in links if a}


def test_secrets(spark):
    for t in [*SECRETS, *AWKWARD]:
        found = secretscan.find_spans(t or "")
        assert sorted(x for x in found if x[0] in secretscan.BASE_KINDS) == sorted(brute_spans(t))
    kinds = [{k for k, *_ in secretscan.find_spans(t)} for t in SECRETS]
    assert kinds[3] == set() and kinds[5] == set() and kinds[6] == set() and kinds[7] == set()
    assert kinds[4] == {"link_access", "link_secret", "link_endpoint"} and kinds[8] == set() and kinds[9] == {"link_secret", "link_endpoint"}
    (link,) = secretscan.find_credentials(SECRETS[4])[1]
    assert [SECRETS[4][s:e] for _, s, e in link] == ["client_id: abc-1", "9f8Kd02LmQ7xWv4Tz1Bn", "https://api.example.org/v1"]
    assert [[SECRETS[10][x[1] : x[2]] for x in link[:2]] for link in secretscan.find_credentials(SECRETS[10])[1]] == [["login=ann", "key1abcdefghij234567"], ["login=eve", "key1abcdefghij234567"], ["user=max", "77aabbccddeeff0011223344"]]
    red = secretscan.redact_secrets(frame(spark, SECRETS))
    out = {r["doc_id"]: r["text"] for r in red.collect()}
    assert "9f8K" not in out[4] and "9f8K" in out[5] and red.columns == frame(spark, []).columns


def test_links_by_brute_force():
    r = random.Random(4)
    parts = ["user: bob", "client_id=c-17", "AKIA" + "B7" * 9, "password = hunter2222", "9f8Kd02LmQ7xWv4Tz1Bn", "0123456789abcdef01234567", "https://a.b/c", "redis://h:1", "word " * 12, "\n\n", "x" * 60]
    seen = 0
    for _ in range(400):
        text = " ".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        want, got = brute_links(text, 80)
        assert got == want
        seen += len(got)
    assert seen > 300


def test_secret_rows(docs, empty):
    assert secretscan.secret_spans(docs).count() == docs.count() and secretscan.secret_spans(empty).count() == 0


# ---- 2 ---------------------------------------------------------------------------


def test_top_k(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(180)]
    rows += [(200 + i, rows[0][1]) for i in range(8)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (350, [0.5, 0.5]), (None, [1.0]), (50, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(u, i, [math.floor(256 * x) for x in v]) for u, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for u, q, a in ok:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i, w) for w, i, b in ok if w != u)[:5]
            want += [(q, k, i, -x) for k, (x, i, _) in enumerate(s, 1)]
    got = topk.top_k(df, block_rows=40, query_rows=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def best_of(rows, k=5, every=50):
    """(query_id, rank, vec_id, score) by plain integers."""
    whole = [(u, i, [topk.whole(x, 256) for x in v]) for u, (i, v) in enumerate(rows)]
    out = []
    for u, q, a in whole:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i, w) for w, i, b in whole if w != u)[:k]
            out += [(q, r, i, -x if -(2**63) <= -x < 2**63 else None) for r, (x, i, _) in enumerate(s, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1e3, 1e7, 6e8, 1e12, 1e200, 1e306])
def test_top_k_huge(spark, size):
    """Components of any finite size among plain ones, as queries and as candidates; scores beyond 64 bits have no number but their rank."""
    r = random.Random(size)
    rows = [(i, [r.uniform(-1, 1) * (size if i % 9 == 0 else 1) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, block_rows=40, query_rows=2).collect()), key=str)
    assert got == best_of(rows) and len(got) == 15


def test_proof_on_dense_vectors():
    """The bounds never lose one of the best, for any signs and cells; on dense vectors too they hold before all postings are processed."""
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (900, 12)) * r.choice([0, 1], (900, 12), p=[0.2, 0.8])
    index, shares = topk.ImpactIndex(np.arange(900), np.arange(900), list(x), 12), []
    for i in range(0, 900, 30):
        q = np.floor(r.normal(0, 1, 12) * 256)
        some, share = index.possible(q, i, 5)
        exact = np.delete(index.x[index.rows] @ q, i)
        best = np.delete(np.arange(900), i)[exact >= np.sort(exact)[-5]]
        assert set(best.tolist()) <= set(some.tolist()) and len(some) <= 900 * topk.RESCORE_SHARE
        shares.append(share)
    assert max(shares) < 1


def test_top_k_proof(spark):
    """Skewed vectors are proved long before all postings are processed; the share is told."""
    r = np.random.default_rng(1)
    x = r.exponential(1.0, (3000, 16)) ** 4 * (r.random((3000, 16)) < 0.15)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, with_share=True).collect()
    assert sorted((tuple(g)[:4] for g in got), key=str) == best_of([(i, v.tolist()) for i, v in enumerate(x)]) and max(g["share"] for g in got) < 0.2
    keys = [-(10**30), -257, -256, -1, 0, 1, 255, 256, 10**30]
    assert sorted(map(topk.order_key, keys)) == list(map(topk.order_key, keys))


# ---- 3 ---------------------------------------------------------------------------


def long_runs():
    """Runs on both sides of the lengths at which they are cut out, alone and between words, and kinds of white space."""
    n = common.LONG_BLANK
    for c in (" ", "\n", "\t", "\u00a0", " \n", "a", "1", "!"):
        for m in (n // len(c) - 1, n // len(c) + 1, *[1_000_200] * (c in " \n")):
            yield c * m
            yield f"word{c * m}next it's{c * m}<|endoftext|>{c * n}"


def test_long_runs_have_the_library_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    library, encoding = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), common.byte_tokenizer(common.byte_bpe_path())
    for t in long_runs():
        assert common.byte_ids(encoding, t) == library.encode(t, add_special_tokens=False).ids, (t[:5], len(t))


@pytest.mark.parametrize("c", [" ", "\n", "\t", "a"])
def test_runs_of_ten_million(c):
    """A run is encoded by powers of itself; whatever its length, a text's ids give the text back."""
    encoding = common.byte_tokenizer(common.byte_bpe_path())
    assert encoding.decode(common.byte_ids(encoding, "x" + c * 10**7 + "y")) == "x" + c * 10**7 + "y"


def test_pack_and_count_long_runs(spark):
    texts = [" " * 1_000_200, "a" + "\n" * 1_000_200, "\t" * 1_000_200 + "b", "z" * 1_000_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = {r[0]: r[1] for r in tokencount.token_lengths(df).collect()}
    got = packing.pack(df).collect()
    whole = Counter()
    for r in got:
        whole[r.doc_id] += r.length
        assert r.doc_tokens == n[r.doc_id] + 1
    assert whole == {i: m + 1 for i, m in n.items()}


def test_tournament():
    r = random.Random(2)
    items = [r.randint(1, 100) for _ in range(300)]
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: -items[i]):
        for b, f in enumerate(free):
            if f >= items[i]:
                break
        else:
            b = len(free)
            free.append(100)
        free[b] -= items[i]
        want[i] = b
    assert packing.first_fit_decreasing(items, 100) == [want[i] for i in range(300)]


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    many = docs.unionByName(frame(spark, [prose(k, 40 + 37 * k % 900) for k in range(60)], 1000).filter("doc_id is not null"))
    ids = {r["doc_id"]: np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4") for r in many.collect()}
    rows = packing.pack(many).collect()
    by, seq = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, parts in by.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[doc])
    assert by.keys() == ids.keys()
    padding = 0
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 2048 + 0.02 * sum(map(len, ids.values()))
    assert packing.pack(empty).count() == 0


# ---- 4 ---------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    d = docs.unionByName(frame(spark, [prose(k % 3, 300, 400) for k in range(80)], 2000).filter("doc_id is not null"))
    rows = {r["doc_id"]: r for r in recurrent.lm_scores(d).collect()}
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws_ in tokens.items() if not held[i] for w in ws_)
    n, v = sum(c.values()), len(c)
    for i, r in rows.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9 and r["score"] < 0
    assert sum(r["score"] for r in rows.values() if r["held_out"]) > sum(r["base_score"] for r in rows.values() if r["held_out"])
    assert recurrent.lm_scores(empty).count() == 0


def test_network_sees_every_document(spark):
    """Each text has a word of its own, whose input vector moves only if that text is trained on; one id, and none, for many texts."""
    rows = [(i if i < 40 else 7 if i < 50 else None, f"own{i} " * 60) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lex = recurrent.lexicon(common.stored(recurrent.word_counts(d), "counts"))
    net, start = recurrent.trained(recurrent.coded(d, lex), lex), recurrent.Network(lex)
    moved = np.abs(net.p["emb"] - start.p["emb"]).max(1)[: len(lex.head)] > 0
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    assert len(lex.head) == len(rows) - sum(held) + 1 and moved.all()


def test_training_leaves_no_symbol_over():
    for n in (1, 2, 79, 160, 5000, 90_001):
        for streams in (16, 512):
            b, length = recurrent.layout(n, streams)
            left = n - b * length
            assert 1 <= left <= streams and recurrent.layout(left, streams)[0] * recurrent.layout(left, streams)[1] >= left - streams


def test_training_does_not_depend_on_partitions(spark):
    """Held-out scores of one and of 64 partitions, and of a network that has learned nothing."""
    chain, rows = random.Random(12), []
    follow = {k: [chain.randrange(150) for _ in range(3)] for k in range(150)}
    for i in range(300):
        k, text = chain.randrange(150), []
        for _ in range(250):
            k = chain.choice(follow[k])
            text.append(f"w{k}")
        rows.append((i, " ".join(text)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    total = lambda df: sum(r["score"] for r in df.filter("held_out").collect())
    one, many = total(recurrent.lm_scores(d.repartition(1))), total(recurrent.lm_scores(d.repartition(64, "doc_id")))
    lex = recurrent.lexicon(common.stored(recurrent.word_counts(d), "counts"))
    code = recurrent.coded(d, lex)
    untrained = recurrent.Network(lex)
    none = sum(untrained.score(np.frombuffer(r["symbols"], "<i2"), np.array([0, r["n_tokens"]]))[0] / math.log(10) + r["tail"] for r in code.filter("word is null and held_out").collect())
    assert abs(one - many) < 0.01 * abs(one) and one > 0.95 * none


def test_head_is_never_empty(spark):
    """All words equally frequent, and more of them than a worker may hold."""
    d = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(200))) for k in range(50)], "doc_id long, text string")
    counts = common.stored(recurrent.word_counts(d), "counts")
    lex = recurrent.lexicon(counts, 3000)
    assert len(lex.head) == recurrent.CLASSES * recurrent.CLASS_WORDS and 2500 < len(lex.hashes) <= 3000 and lex.end >= 0
    assert int(lex.head_counts.sum() + lex.tail_total.sum()) == lex.tokens


@pytest.mark.parametrize("window", [1, 64, 1 << 14])
def test_scores_step_by_step(monkeypatch, window):
    """The state is carried over windows: scores against a loop over single steps, around the windows' borders."""
    monkeypatch.setattr(recurrent, "WINDOW", window)
    lex = recurrent.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.append(np.arange(1, 40, dtype=np.uint64), recurrent.END), np.arange(40, 0, -1), np.ones(recurrent.TAIL_CLASSES), np.ones(recurrent.TAIL_CLASSES), 100, 50, 0.5)
    net, rng = recurrent.Network(lex), np.random.default_rng(3)
    for k, p in net.p.items():
        net.p[k] = (p + (0 if k == "bw" else rng.normal(0, 0.3, p.shape))).astype(np.float32)
    lens = [1, 63, 64, 65, 128, 129, 300, 2]
    ptr = np.concatenate([[0], np.cumsum(lens)])
    symbols = rng.integers(0, 40 + recurrent.TAIL_CLASSES, ptr[-1])
    p, want = net.p, []
    for a, b in zip(ptr[:-1], ptr[1:]):
        h, last, total = np.zeros(recurrent.HIDDEN), net.end, 0.0
        for y in symbols[a:b]:
            gates, u = p["emb"][last] @ p["wx"] + p["bx"], h @ p["wh"]
            r, z = (1 / (1 + np.exp(-(gates[k : k + recurrent.HIDDEN] + u[k : k + recurrent.HIDDEN]))) for k in (0, recurrent.HIDDEN))
            n = np.tanh(gates[2 * recurrent.HIDDEN :] + r * u[2 * recurrent.HIDDEN :])
            h = (1 - z) * n + z * h
            s = h @ p["wc"] + p["bc"]
            c = net.classes + y - net.k if y >= net.k else y // recurrent.CLASS_WORDS
            total += s[c] - np.log(np.exp(s).sum())
            if y < net.k:
                s = h @ p["ww"][c] + p["bw"][c]
                total += s[y % recurrent.CLASS_WORDS] - np.log(np.exp(s).sum())
            last = y
        want.append(total)
    assert np.allclose(net.score(symbols, ptr), want, rtol=1e-4)


def test_lexicon_finds_words():
    rng = np.random.default_rng(4)
    h = np.unique(np.concatenate([rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2), np.arange(200, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(9, dtype=np.uint64)]))
    lex = recurrent.Lexicon(h, h, h, h, h, h, h, 1, 1, 0.5)
    ask = np.concatenate([h, h + np.uint64(1), rng.integers(0, 2**63, 500).astype(np.uint64)])
    want = np.where(h[np.minimum(np.searchsorted(h, ask), len(h) - 1)] == ask, np.searchsorted(h, ask), -1)
    assert (lex.find(ask) == want).all() and recurrent.Lexicon(h[:0], h, h, h, h, h, h, 1, 1, 0.5).find(ask).max() == -1


def test_network_gradients():
    lex = recurrent.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.append(np.arange(1, 40, dtype=np.uint64), recurrent.END), np.arange(40, 0, -1), np.ones(recurrent.TAIL_CLASSES), np.ones(recurrent.TAIL_CLASSES), 100, 50, 0.5)
    net, rng = recurrent.Network(lex), np.random.default_rng(0)
    for k, p in net.p.items():
        net.p[k] = p.astype(np.float64) + (0 if k == "bw" else rng.normal(0, 0.1, p.shape))
    x, y, h = rng.integers(0, 60, (3, 5)), rng.integers(0, 40, (3, 5)), rng.normal(0, 1, (3, recurrent.HIDDEN))

    def loss():
        gates, s, out = net.p["emb"] @ net.p["wx"] + net.p["bx"], h, 0.0
        for i in range(5):
            s = net.step(gates[x[:, i]], s * (x[:, i] != net.end)[:, None])[0]
            out -= net.log_probs(s, y[:, i]).sum() / 15
        return out

    g, _ = net.gradients(x, y, h)
    for k in ("emb", "wx", "wh", "wc", "bc", "ww"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        kept = net.p[k][at]
        net.p[k][at] = kept + 1e-5
        up = loss()
        net.p[k][at] = kept - 1e-5
        down = loss()
        net.p[k][at] = kept
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1e-3, abs(g[k][at])) + 1e-6, k


def test_probabilities_sum_to_one():
    lex = recurrent.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.append(np.arange(1, 40, dtype=np.uint64), recurrent.END), np.arange(40, 0, -1), np.full(recurrent.TAIL_CLASSES, 9.0), np.full(recurrent.TAIL_CLASSES, 3.0), 100, 50, 0.5)
    net = recurrent.Network(lex)
    h = np.random.default_rng(1).normal(0, 1, (1, recurrent.HIDDEN)).astype(np.float32)
    every = np.arange(40 + recurrent.TAIL_CLASSES)
    assert abs(np.exp(net.log_probs(np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-4
    g = np.zeros(4, int)
    assert abs((10 ** lex.inside_tail(np.array([2, 3, 4, 0]), g)).sum() - 1) < 1e-9  # three words with 9 tokens, and the unknown one


# ---- 5 ---------------------------------------------------------------------------


def brute_components(texts, percent=85, size=4):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("percent", "size"), [(85, 4), (80, 5)])
def test_jaccard(spark, percent, size):
    r, texts = random.Random(9), []
    for k in range(60):
        base = prose(k, r.choice([4, 6, 8, 9, 10, 12, 14, 16, 17, 18, 20, 25, 60, 200])).split()
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
                op = r.random()
                if op < 0.4:
                    copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
                elif op < 0.7:
                    copy.append(f"end{r.randrange(10**6)}")
                elif len(copy) > 4:
                    copy.pop()
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    df = frame(spark, AWKWARD + texts)
    want = brute_components({row["doc_id"]: row["text"] for row in df.filter("doc_id is not null").collect()}, percent, size)
    got = {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in jaccard.similar_components(df, percent, size).collect()}
    assert got.pop(None)[1] is None
    assert got == want


@pytest.mark.parametrize(("percent", "block"), [(85, 2048), (80, 7)])
def test_jaccard_links(spark, monkeypatch, percent, block):
    """Every pair counts: a large group of differing near copies, exact copies and a chain, in one block and in many."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    base, tail, texts = prose(5, 240).split(), prose(6, 90, 10**6).split(), []
    for k in range(60):
        copy = list(base)
        for e in range(k % 5):
            copy[(7 * k + 48 * e) % 240] = f"new{k}"
        texts += [" ".join(copy)] * (1 + k % 3)
    texts += [" ".join(tail[k : k + 60]) for k in range(0, 30, 3)]
    df = frame(spark, AWKWARD + texts)
    sets = {}
    for row in df.collect():
        w = WORD.findall(lower(row["text"]))
        sets[row["doc_id"]] = {tuple(w)} if 0 < len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    want = {i: sum(i != j and bool(a & b) and 100 * len(a & b) >= percent * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    got = {row["doc_id"]: row["n_links"] for row in jaccard.similar_components(df, percent, with_links=True).collect()}
    assert got == want and max(want.values()) > 50 and len(set(want.values())) > 5


def test_template_lists(spark):
    """Many texts of one template that share a little less than a link needs, a few that link, and near copies: no list pairs up with itself."""
    body = [f"t{k}" for k in range(100)]
    texts = {i: " ".join([*body, *(f"own{i}x{j}" for j in range(10))]) for i in range(3000)}
    texts |= {5000 + i: " ".join([*body, f"end{i}"]) for i in range(40)}
    texts[6000] = " ".join(["x0", *body[1:], *(f"own7x{j}" for j in range(10))])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_components(d).collect()}
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in texts.items()}
    link = lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    assert not link(0, 1) and link(5000, 5001) and link(6000, 7) and link(0, 5000)
    assert len(set(got.values())) == 1  # each of the 3000 links with the 40, none with another one of them


def test_template_pairs(spark):
    """Lists of 100,000 near misses: no pair comes out, and none is tried."""
    rows = spark.range(100_000).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("key"), F.col("id").alias("fp"), F.lit(107).cast("long").alias("n"), F.lit(11).cast("long").alias("pos"), F.col("id").alias("comp"))
    assert jaccard.cross_pairs(rows).count() == 0
    some = rows.withColumn("pos", F.when(F.col("fp") < 3, F.lit(2).cast("long")).otherwise(F.col("pos"))).filter("fp < 50")
    assert jaccard.cross_pairs(some).count() == 3


def test_whole_sets_without_filter(spark, docs):
    d = common.doc_rows(docs)
    wanted = jaccard.set_sizes(d).filter("part is null and n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    a, b = ({r["fp"]: r["items"] for r in jaccard.whole_sets(d, wanted, most_bits=m).collect()} for m in (27, 4))
    assert a == b and len(a) == wanted.count()


def test_representatives(spark):
    """Rows stand for components: repeated ids with other texts, null ids, repeated rows."""
    x, y, z = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(5, x), (5, y), (3, x), (None, y), (None, z), (None, z + " more"), (9, None), (9, ""), (None, None), (3, x)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keep = jaccard.representatives(d)
    got = d.withColumn("th", jaccard.text_hash()).join(keep.withColumnRenamed("doc_id", "id"), "th").filter(F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text").distinct()
    kept = sorted(map(tuple, got.collect()), key=str)
    lone = [r for r in kept if r[0] is None and r[1] and r[1].startswith(z)]
    assert len(lone) == 1 and sorted([r for r in kept if r not in lone], key=str) == sorted([(3, x), (5, y), (9, None), (9, ""), (None, None)], key=str)


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(2)
    for short, columns in ((32, 2048), (3, 16)):
        monkeypatch.setattr(jaccard, "SHORT_LIST", short)
        monkeypatch.setattr(jaccard, "DENSE_COLUMNS", columns)
        a, b = ([np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(n)] for n in (50, 40))
        assert (jaccard.shared_counts(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
        assert (np.triu(jaccard.shared_counts(a, None), 1) == np.triu([[len(np.intersect1d(x, y)) for y in a] for x in a], 1)).all()


def test_jaccard_rows(empty, docs):
    assert jaccard.similar_components(empty).count() == 0
    twice = docs.unionByName(docs)
    assert jaccard.similar_components(twice).count() == 2 * docs.count()


def test_light_subsets_meet():
    for light in (8, 14, 20):
        for a in range(1, light + 1):
            for b in range(a, min(light, 100 * a // 85) + 1):
                assert set(jaccard.subset_sizes(a, light)) & {jaccard.need(b)} and jaccard.need(b) in jaccard.subset_sizes(b, light)


# ---- 6 ---------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), dup, len(covered)


def test_quality_counts(docs):
    rows = quality.quality_verdicts(docs, quality.DecisionList())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows.collect():
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) == (not r["kept"])


def test_quality_rules(spark, docs, empty):
    texts = [prose(k, 120) for k in range(80)] + [" ".join(f"{w}###" for w in prose(k, 120).split()) for k in range(40)] + [prose(k, 120).upper() + " !!" for k in range(40)]
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 160, 2)] + [(None, 1, None), (7, None, None)], "doc_id long, quality int, toxic int")
    rules = quality.fit(df, labels)
    kept = {r["doc_id"] for r in quality.keep_good(df.drop("n_words"), rules).collect()}
    assert len(kept & set(range(80))) >= 75 and len(kept - set(range(80))) <= 4 and "reject" in str(rules)
    held = [i for i in range(160) if i % 2]  # never labelled
    assert sum((i in kept) == (i < 80) for i in held) >= 0.95 * len(held)
    again = df.unionByName(df.withColumn("text", F.concat("text", F.lit(" ### !!")))).repartition(7)  # an id with other texts teaches once, in whatever order
    one, two = quality.fit(again, labels), quality.fit(again.orderBy(F.rand(3)), labels.unionByName(labels))
    assert one == two
    assert quality.fit(df, labels.limit(0)).rules == () and quality.keep_good(empty, rules).count() == 0


# ---- 7 ---------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, None, None), (None, 0, "user", "x"), (5, 0, "user", "c"), (5, 0, "bot", "c"), (5, None, "sys", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["n_logged"], r["text"]) for r in chat.format_chats(df).collect()}
    assert got == {2: (2, 2, "<|user|>\na<|end|>\n<|bot|>\nb<|end|>\n"), 4: (1, 1, "<|unknown|>\n<|end|>\n"), 5: (3, 1, "<|sys|>\ns<|end|>\n<|bot|>\nc<|end|>\n<|user|>\nc<|end|>\n")}
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = chat.format_chats(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_chats(rows):
    """conv_id of the maximal conversations, from whole lists of turns."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role, text))
    by = {c: sorted(x) for c, x in by.items()}
    longer = [x for x in by.values()]
    keep = {c for c, x in by.items() if not any(len(o) > len(x) and o[: len(x)] == x for o in longer)}
    first = {}
    for c in sorted(keep):
        first.setdefault(tuple(by[c]), c)
    return set(first.values())


def test_chat_tied_turns(spark):
    """Two turns of one number and role: hashes and rendering must put them in one order."""
    r, rows = random.Random(3), []
    for c in range(66):
        a, b = sorted([f"first {r.random()}", f"second {r.random()}"], key=lambda _: r.random())
        rows += [(2 * c, 0, "user", a), (2 * c, 0, "user", b), (2 * c + 1, 0, "user", max(a, b))]
    assert brute_chats(rows) == set(range(132))
    rows += [(1000 + c, t, "user", r.choice("xyz")) for c in range(200) for t in [0, 0, 1, 1, 2][: r.randint(1, 5)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {x["conv_id"] for x in chat.format_chats(df).collect()} == brute_chats(rows)


# ---- 8 ---------------------------------------------------------------------------


def test_token_counts(docs, empty):
    n = [r["n_tokens"] for r in tokencount.token_lengths(docs).collect()]
    sums = tokencount.suffix_sums(tokencount.length_histogram(tokencount.token_lengths(docs)), block=16).cache()
    for r in sums.collect():
        x = r["length"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["tokens_kept"], r["tokens_lost"], r["docs_up_to"]) == (n.count(x), sum(k >= x for k in n), sum(k for k in n if k >= x), sum(min(k, x) for k in n), sum(max(k - x, 0) for k in n), sum(k <= x for k in n))
    edges = sorted((r["limit_from"], r["length"], r["tokens_below"], r["docs_at_least"]) for r in sums.collect())
    assert edges[0][0] == 0 and all(a[1] + 1 == b[0] for a, b in zip(edges, edges[1:]))
    for limit in [*range(200), 1000, 2999, max(n)]:
        low, high, below, docs_ = next(e for e in edges if e[0] <= limit <= e[1])
        assert below + limit * docs_ == sum(min(k, limit) for k in n)
    for r in tokencount.at_limits(sums, [0, 7, 10**6]).collect():
        assert (r["docs_truncated"], r["tokens_kept"], r["tokens_lost"]) == (sum(k > r["limit"] for k in n), sum(min(k, r["limit"]) for k in n), sum(max(k - r["limit"], 0) for k in n))
    assert tokencount.quantile(sums, 0.5).first()[0] == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert tokencount.suffix_sums(tokencount.length_histogram(tokencount.token_lengths(empty))).count() == 0


# ---- 9 ---------------------------------------------------------------------------


def test_chain_marginals():
    from itertools import product

    rng = np.random.default_rng(4)
    bias, trans = -1.5, rng.normal(0, 1, (2, 2))
    for n in range(1, 8):
        active = np.sort(rng.choice(n, rng.integers(1, n + 1), replace=False))
        pot = rng.normal(0, 2, len(active))
        emission = np.full(n, bias)
        emission[active] = pot
        weight, hit = 0.0, np.zeros(n)
        for tags in product((0, 1), repeat=n):
            p = math.exp(sum(e for e, t in zip(emission, tags) if t) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
            weight += p
            hit += p * np.array(tags)
        gap = np.diff(np.append(-1, active)) - 1
        got = toxicity.chain_marginals(pot, gap, np.array([n - 1 - active[-1]]), np.array([0, len(active)]), bias, trans)
        assert np.allclose(got, (hit / weight)[active])


def test_toxicity(spark, docs, empty):
    r, texts, toxic = random.Random(6), [], []
    for k in range(400):
        words = prose(k % 5, 60).split()
        bad = r.random() < 0.3
        for _ in range(3 * bad):
            words.insert(r.randrange(len(words)), r.choice(["Vileword,", "nastyword", "vilewords"]))
        texts.append(" ".join(words) + f" end{k}")
        toxic.append(int(bad))
    df = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    rows = {x["doc_id"]: x for x in toxicity.score_toxicity(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((rows[i]["score"] >= 0.7) == bool(toxic[i]) for i in held) >= 0.97 * len(held)
    hit = next(i for i in held if toxic[i])
    assert {re.sub(r"\W", "", texts[hit][s["start"] : s["end"]]).lower() for s in rows[hit]["toxic_spans"]} <= {"vileword", "nastyword", "vilewords"}
    assert {x["doc_id"] for x in toxicity.keep_clean(df.drop("score"), model).collect()} >= {i for i in held if not toxic[i]}
    scored = toxicity.score_toxicity(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= x["score"] <= 1 for x in scored) and toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit(df, labels.filter("toxic = 0")).prior == 0.0 and toxicity.fit(df, labels.limit(0)).prior == 0.0


def test_tokens_without_punctuation():
    texts = ["!!!!!!word.... ((((((x)))))) ... a'b, \u00e9!", "", "?" * 50 + "end" + "\"" * 9]
    got = [[bytes(t.data[s:e]).decode() for s, e in zip(t.starts, t.ends)] for *_, t in toxicity.tokens(pa.array(texts))]
    assert got == [["word", "x", "...", "a'b", "\u00e9", "end"]]


def test_windows():
    places = np.arange(10).reshape(5, 2)
    p, y, mask = toxicity.windows_of(places, np.array([1, 0, 1, 1, 0]), np.array([2, 0, 9, 3, 1]), np.array([0, 4, 4, 5]))
    assert mask.sum(1).tolist() == [4, 8, 2]  # two tokens; a far one and the next; the other document's
    assert y[0, :4].tolist() == [0, 0, 1, 0] and p[1, 3].tolist() == [4, 5] and p[1, 7].tolist() == [6, 7] and (p[1, :3] == -1).all() and p[2, 1].tolist() == [8, 9]


def test_scores_by_brute_force(spark):
    """Whole scores: forward and backward over every token, plain ones too."""
    r, texts, toxic = random.Random(8), [], []
    for k in range(150):
        words = prose(k % 4, r.randint(1, 90)).split()
        bad = r.random() < 0.4
        for _ in range(4 * bad):
            words.insert(r.randrange(len(words)), r.choice(["(Grimword)", "meanword!!!!!!", "grimwords"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    texts += ["", " ", "grimword", "plain"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int"))
    assert len(model.hashes) and any(model.calibration)
    (_, _, every), = toxicity.tokens(pa.array(["meanword grimword"]))
    assert (model.lookup(every.features)[:, 0] >= 0).all()
    got = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(d, model).collect()}
    t, weights = np.exp(model.trans), np.append(model.weights, 0.0)
    for i, text in enumerate(texts):
        top, total = 1e-4, 0.0
        if text.split():
            (_, _, one), = toxicity.tokens(pa.array([text]))
            places = model.lookup(one.features)
            emit = [np.array([1.0, math.exp(min(60, model.bias + weights[p].sum()))]) for p in places]
            alpha, beta = [emit[0] / emit[0].sum()], [np.ones(2)]
            for e in emit[1:]:
                alpha.append(alpha[-1] @ t * e)
                alpha[-1] /= alpha[-1].sum()
            for e in emit[:0:-1]:
                beta.append(t @ (e * beta[-1]))
                beta[-1] /= beta[-1].sum()
            for a, b, p in zip(alpha, beta[::-1], places):
                q = (a * b / (a * b).sum())[1]
                if (p >= 0).any():
                    top, total = max(top, q), total + q * (q > 0.05)
        top, c = min(top, 1 - 1e-4), model.calibration
        want = 1 / (1 + math.exp(-(c[0] + c[1] * math.log(top / (1 - top)) + c[2] * math.log1p(total))))
        assert abs(got[i] - want) < 1e-6, (i, text)


# ---- 10 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.word_bpe_path())


def test_bpe(docs, empty, library):
    want = {}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in bpe.encode_digests(docs).collect()} == want
    joined = bpe.decode_ids(bpe.encode_texts(docs), join_tokens=True)
    assert {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in joined.collect()} == {k: v[2] for k, v in want.items()}
    assert bpe.encode_digests(empty).count() == 0


def fed(enc, text, size):
    machine, out = bpe.Transducer(enc, 4), []
    data = text.encode()
    for k in range(0, len(data), size):
        out += machine.feed(data[k : k + size])
        assert len(machine.held) <= machine.limit
    return out + machine.finish()


def test_long_pretokens(library):
    """The heap's merges are the scan's, and a megabyte of letters or of punctuation has the library's ids."""
    enc, r = bpe.encoder(common.word_bpe_path()), random.Random(3)
    for _ in range(300):
        word = [enc.inner[b] for b in "".join(r.choice("abcdefinorst") for _ in range(r.randrange(49, 400))).encode()]
        pairs, scan = [enc.ranks.get(p, bpe.NO_MERGE) for p in zip(word, word[1:], strict=False)], list(word)
        while pairs and (best := min(pairs)) != bpe.NO_MERGE:
            i = pairs.index(best)
            scan[i : i + 2] = [enc.made[best]]
            pairs = [enc.ranks.get(p, bpe.NO_MERGE) for p in zip(scan, scan[1:], strict=False)]
        assert enc.merge(list(word)) == scan
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "!?.,;:-", "é", "a"):
        t = "".join(r.choices(alphabet, k=1_000_000 // len(alphabet[0].encode())))
        assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_bpe_transducer(library):
    enc, r = bpe.encoder(common.word_bpe_path()), random.Random(8)
    for k in range(30):
        w = "".join(r.choice(r.choice(["ab", "thein", "aeiouy", "abcdefghijklmnopqrstuvwxyz"])) for _ in range(700 if k else 3))
        whole = enc.merge([*(enc.inner[b] for b in w.encode()[:-1]), enc.last[w.encode()[-1]]])
        assert fed(enc, w, 50) == fed(enc, w, 1) == whole == library.encode(w, add_special_tokens=False).ids
    for t in ["a é日本 🙂 12", "x" * 3000, "plain words here"]:
        machine = bpe.Decoder(enc, False)
        assert "".join([*(machine.feed([i]) for i in enc.encode(t).tolist()), machine.finish()]).split() == t.replace("12", "1 2").split()


HARD = [
    "don't we'll I'RE it" + "'" * 3 + "s !!'s 'r 're 'll",
    "<|endoftext|>a<|startoftext|><|endof|><|endoftext",
    "e\u0301e\u0323\u0302 A\u030a \u1112\u1161\u11ab \u212b",
    "ΑΣ Σας ẞİ ǅ",
    "x" * 90 + "!?" * 60 + "é" * 40,
    "٣४5½Ⅷ",
    "\u00a0\u2003\x85\x1c-\u200b",
    "日本語" * 50 + "'s" + "z" * 70,
    "a\u0300\u0301\u0302" * 40,
]


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_bpe_blocks(library, monkeypatch, size):
    """Whatever the blocks a text comes in, ids and decoded text are the library's."""
    monkeypatch.setattr(bpe, "LONG_RUN", 16)
    enc = bpe.encoder(common.word_bpe_path())
    for t in [*AWKWARD[:8], *HARD, " ".join(HARD), "".join(HARD)]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        blocks = list(bpe.text_blocks(memoryview((t or "").encode()), size))
        assert "".join(blocks) == (t or "")
        assert np.frombuffer(b"".join(enc.encode_blocks(blocks)), "<u4").tolist() == ids
        want = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert bpe.digests(enc, blocks)[::2] == (len(ids), want)


@pytest.mark.parametrize("word", ["word ", "z", "日", "!"])
def test_bpe_memory(word):
    """A long text, of words or of one pre-token, needs no more memory than a short one."""
    import tracemalloc

    enc = bpe.encoder(common.word_bpe_path())
    size = 20 << 20 if word == "word " else 1 << 18
    bpe.digests(enc, [word * 100])
    tracemalloc.start()
    bpe.digests(enc, (word * (1 << 13) for _ in range(size // (len(word) << 13))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_byte_vocabularies_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), common.byte_tokenizer(common.byte_bpe_path())
    texts = [*AWKWARD, *HARD]
    if os.path.isdir("/root/testdata/sf0.01"):
        texts += pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for s in texts:
        assert t.encode(s or "", add_special_tokens=False).ids == e.encode(s or "", allowed_special="all")


def test_long_documents_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "DEALT_PIECES", 2)
    d = spark.createDataFrame([(1, "word " * 200), (2, "x"), (1, "word " * 200)], "doc_id long, text string")
    pieces = packing.token_pieces(d, 16).groupBy("doc_id", "salt").count().collect()
    assert max(r["count"] for r in pieces) == 2 and len(pieces) > 10
    assert packing.pack(d, 16, 4).groupBy("doc_id").agg(F.sum("length").alias("n")).filter("doc_id = 1").first()["n"] == 2 * packing.token_pieces(d).filter("doc_id = 1").first()["doc_tokens"]


def test_network_keeps_its_memory():
    """Updates and scores don't get their arrays' pages from the system again and again."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np
from mailloom.llm import recurrent as R
lex = R.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.append(np.arange(1, 1024, dtype=np.uint64), R.END), np.arange(1024, 0, -1), np.ones(R.TAIL_CLASSES), np.ones(R.TAIL_CLASSES), 100, 50, 0.5)
net, x = R.Network(lex), np.random.default_rng(1).integers(0, 1056, 262 * 20 * 20 + 1).astype(np.int16)
R.keep_memory()
faults = []
for _ in range(3):
    net.train(x, 262, 0.01, {}, 0)
    net.score(x[:40_000], np.arange(0, 40_001, 100))
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print(faults[2] - faults[1])
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 5000

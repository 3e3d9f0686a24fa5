"""SimHash links, whitening and periodic runs against brute force, on ordinary and awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from mailloom.llm import periodic, simhash, whitening
from mailloom.llm import wordscan as ws

from .test_llm import AWKWARD, frame, lower, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots_of(links, nodes):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in links:
        root[top(u)] = top(v)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 20])
def test_word_blocks(size):
    for t in ["", " ", "a", "ab cd", "  x\ty\n", "one two three four", "é ü \x1c日本\x0b"]:
        got = [w for block in ws.word_blocks(t.encode(), size) for w in block]
        assert got == [w.encode() for w in WORD.findall(t)]


# ---- 11 --------------------------------------------------------------------------


def brute_fingerprint(t, size=3):
    w = WORD.findall(lower(t))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, bits=2):
    """rows (doc_id, text) -> sorted (doc_id, fingerprint, component_id)."""
    fp = [brute_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= bits]
    root = roots_of(links, range(len(fp)))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted(((d, f"{fp[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)


def test_fingerprint_blocks():
    t = prose(3, 500)
    whole = brute_fingerprint(t)
    for size in (1, 7, 64, 1 << 20):
        assert simhash.fingerprint(ws.word_blocks(t.encode(), size)) == whole
    for t in AWKWARD:
        assert simhash.fingerprint(ws.word_blocks(lower(t).encode())) == brute_fingerprint(t)


def edited(seed, t, n):
    r = random.Random(seed)
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("light", "segments"), [(32, None), (2, 8)])
def test_simhash(spark, light, segments):
    base = [prose(k, 150) for k in range(4)]
    texts = AWKWARD + base + [edited(k, base[k % 4], 1 + k % 4).upper() for k in range(160)] + ["only two", "Only Two", "A"]
    docs = frame(spark, texts)
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = simhash.near_components(docs, light=light, segments=segments).collect()
    want = brute_components(rows)
    assert sorted(map(tuple, got), key=str) == want
    assert max(Counter(c for *_, c in want).values()) > 5


@pytest.mark.parametrize(("light", "segments"), [(2, 8), (32, 16), (3, 32)])
def test_near_links_of_dense_bits(spark, light, segments):
    """Clusters of fingerprints around few centres: each grid has crowded points."""
    r = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(3):
        c = r.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(150)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = roots_of([(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(df, light, segments).collect()], fps)
    want = roots_of([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    group = lambda roots: sorted(sorted(n for n in fps if roots[n] == t) for t in set(roots.values()))
    assert group(got) == group(want)


@pytest.mark.parametrize("segments", simhash.SEGMENTS)
def test_popcounts(spark, segments):
    r, width = random.Random(1), 64 // segments
    fps = [0, -1, 1, -(1 << 63), *(r.getrandbits(64) - (1 << 63) for _ in range(50))]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    counts = lambda p: [p % 2**64 >> width * k & (1 << width) - 1 for k in range(segments)]
    from pyspark.sql import functions as F

    for fp, own, near in df.select("fp", simhash.popcounts(F.col("fp"), segments).alias("own")).select("fp", "own", simhash.around(F.col("own"), segments)).collect():
        c = counts(own)
        assert c == [(fp % 2**64 >> width * k & (1 << width) - 1).bit_count() for k in range(segments)]
        near = [counts(p) for p in near]
        assert len(set(map(tuple, near))) == len(near) == 1 + sum((x > 0) + (x < width) for x in c)
        assert all(sum(abs(a - b) for a, b in zip(c, m, strict=True)) <= 1 and 0 <= min(m) and max(m) <= width for m in near)


# ---- 12 --------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "zz", 1.0) for i, v in rows], "vec_id long, embedding array<double>, n string, whitened double")


def brute_whitened(rows, k=4):
    """The fit list by plain sets, the eigenvectors by a dense solver."""
    import math

    used = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in used)
    x = [tuple(math.floor(256 * c) for c in v) + (0,) * (d - len(v)) for _, v in used]
    fit = sorted(set(x))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    num = np.array([[n * a - b for a, b in zip(r, s, strict=True)] for r in fit], float) / n
    e, u = np.linalg.eigh(num.T @ num / n)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for (i, _), r in zip(used, x, strict=True):
        c = [n * a - b for a, b in zip(r, s, strict=True)]
        out.setdefault(i, []).append((sum(a * a for a in c), np.array(c, float) / n @ u[:, :k] / np.sqrt(e[:k])))
    return n, e[:k] / e.sum(), out


@pytest.mark.parametrize(("d", "guard"), [(3, 12), (7, 0), (40, 4), (64, 12)])
def test_whitening(spark, d, guard):
    r = np.random.default_rng(d)
    x = (r.standard_normal((300, d)) * np.linspace(3, 0.5, d) + 5) @ np.linalg.qr(r.standard_normal((d, d)))[0]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(1, rows[1][1]), (900, rows[2][1]), (901, rows[2][1]), (902, None), (903, [None] * d), (904, [float("nan")] * d), (905, [float("inf")] + [0.0] * (d - 1)), (None, [-0.0] * d), (906, [1.0])]
    n, explained, want = brute_whitened(rows)
    got = whitening.whiten(vectors(spark, rows), guard=guard).collect()
    k = min(4, d)
    assert len(got) == k * sum(map(len, want.values()))
    sign = {}
    for g in got:
        assert g.n == n and g.deviation in {w[0] for w in want[g.vec_id]}
        assert abs(g.explained / explained[g.component - 1] - 1) < 1e-10 and g.identity_error < 1e-10 and g.residual < 1e-11
        w = min((w[1][g.component - 1] for w in want[g.vec_id]), key=lambda w: abs(abs(w) - abs(g.whitened)))
        assert abs(abs(w) - abs(g.whitened)) < 1e-8
        if abs(w) > 1e-3:
            assert sign.setdefault(g.component, np.sign(w * g.whitened)) == np.sign(w * g.whitened)


def test_whitening_degenerate(spark):
    of = lambda rows: whitening.whiten(vectors(spark, rows)).collect()
    assert of([]) == of([(1, None)]) == of([(1, [])]) == of([(1, [1.0, 2.0])]) == of([(1, [1.0]), (2, [1.0])]) == []
    line = of([(k, [float(k), 2.0 * k, 0.0]) for k in range(10)])
    assert len(line) == 10 and all(abs(r.explained - 1) < 1e-12 and r.component == 1 for r in line)
    huge = of([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1.0, 3.0])])
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(r.deviation is None for r in huge if r.vec_id < 3)
    one = np.random.default_rng(0).standard_normal((50, 1)).repeat(5, 1).tolist()
    assert {r.component for r in of(list(enumerate(one)))} == {1}


def test_lobpcg_hard_spectra():
    r = np.random.default_rng(2)
    for values in (np.linspace(1, 2, 120), np.array([5.0] * 3 + [1.0] * 97), np.logspace(0, -10, 90), np.array([1.0, 1.0 - 1e-6, 0.5, 0.5 - 1e-7] + [0.1] * 60)):
        u = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
        v = u * values @ u.T
        found = whitening.lobpcg(lambda w, v=v: v @ w, len(values), 4)
        assert np.allclose(found.values, np.sort(values)[::-1][:4], rtol=1e-11)
        assert (np.linalg.norm(v @ found.vectors - found.vectors * found.values, axis=0) < 1e-10).all()
        assert np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-12


# ---- 13 --------------------------------------------------------------------------


def brute_runs(w):
    """All stretches, by the definition, over every period."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q):
                out.setdefault((i, length), q)  # periods rise: the first is the smallest
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def brute_digest(doc_id, t, plant=True):
    w = WORD.findall(t or "")
    n = len(w)
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repetitive(seed):
    r = random.Random(seed)
    out = []
    while len(out) < r.choice([30, 120, 400]):
        unit = [r.choice("abc") for _ in range(r.choice([1, 2, 3, 5, 8, 11, 20]))]
        out += (unit * r.choice([1, 2, 3, 4, 9, 30]))[: r.choice([10, 30, 200])]
    return " ".join(out)


def test_runs_of_small_alphabets():
    for seed in range(400):
        r = random.Random(seed)
        w = repetitive(seed).split() if seed % 2 else [r.choice("ab") for _ in range(r.randrange(60))]
        x, _ = periodic.numbered([[c.encode() for c in w]])
        assert [tuple(r) for r in periodic.runs(x).tolist()] == brute_runs(w), w


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_periodic(spark, monkeypatch, block):
    monkeypatch.setattr(periodic, "BLOCK", block)
    texts = AWKWARD + [prose(k, 300) for k in range(20)] + [repetitive(k) for k in range(60)] + [("x y z " * 300), "a " * 24, "a " * 23]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.limit(3))
    for plant in (True, False):
        got = sorted((tuple(r) for r in periodic.run_digests(docs, plant).collect()), key=str)
        assert got == sorted(((d, *brute_digest(d, t, plant)) for d, t in docs.select("doc_id", "text").collect()), key=str)


def test_periodic_outputs(spark):
    docs = frame(spark, ["a b " * 20 + "end", None, prose(1, 50)])
    assert [tuple(r) for r in periodic.find_runs(docs).collect()] == [(0, 0, 40, 2)]
    assert {r[0]: r[1] for r in periodic.collapsed(docs).collect()} == {0: "a b end", 1: "", 2: " ".join(prose(1, 50).split()), None: "null id text here"}


def test_periodic_of_a_long_text():
    """A period over a whole text of 300,000 words, where every period's grid has places that pass."""
    w = [b"%d" % (k % 50_000) for k in range(300_000)]
    x, _ = periodic.numbered([w])
    assert periodic.runs(x).tolist() == [[0, 300_000, 50_000]]
    x, _ = periodic.numbered([[b"w"] * 300_000])
    assert periodic.runs(x).tolist() == [[0, 300_000, 1]]

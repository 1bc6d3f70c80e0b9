"""Near-duplicate vectors and documents against all pairs."""

import math
import random
import re

import numpy as np
import pytest

from ruleloom.llm import nearcopies, vectors
from ruleloom.llm.common import components


def labels(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    want = labels({x for p in links for x in p if x is not None}, [p for p in links if None not in p])
    got = {x.id: x.component for x in components(df).collect()}
    assert all(want[i] == c for i, c in got.items()) and {i for p in links if None not in p and p[0] != p[1] for i in p} == set(got)


@pytest.mark.parametrize("seed, dim", [(0, 16), (1, 64), (2, 300)])
def test_vectors_against_all_pairs(spark, seed, dim):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((150, dim))
    near = base[rng.integers(0, 12, 250)] + rng.standard_normal((250, dim)) * rng.choice([0.05, 0.2, 0.35, 0.45], (250, 1))
    x = np.concatenate([base, near, near[:5] * 3, base[:3]]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] + [1.0] * (dim - 1), 1), (n + 3, [None] + [1.0] * (dim - 1), 1), (n + 4, [], 1), (n + 5, x[0].tolist() + [0.0], 1), (n + 6, [float("inf")] * dim, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, size int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.vector_links(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    links = np.argwhere(hit)
    comp = labels(range(len(rows)), links.tolist())
    found = sum(got[k][0] for k in range(n))
    assert found <= hit.sum() and found >= 0.99 * hit.sum()
    wrong = [k for k in range(len(rows)) if got[k] != (int(hit[k].sum()) if k < n else 0, comp[k], comp[k] == k)]
    assert len(wrong) <= 0.02 * n and not [k for k in wrong if k >= n]


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.vector_links(spark.createDataFrame([], schema)).count() == 0
    assert vectors.vector_links(spark.createDataFrame([(1, None)], schema)).collect()[0].asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(50)] + [(3, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (99, [1e-30, 2e-30, 3e-30])]
    got = vectors.vector_links(spark.createDataFrame(rows, schema)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(52, 0)} and sum(r.kept for r in got) == 1


def test_estimate_is_unbiased(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    y = x + rng.standard_normal((4000, 64))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    (words, factor), (planes, low, step, total) = vectors.codes(x), vectors.rounded(y)
    rows = list(zip(words.tolist(), factor.tolist(), planes.tolist(), low.tolist(), step.tolist(), total.tolist(), (x * y).sum(axis=1).tolist()))
    df = spark.createDataFrame(rows, "words_a array<long>, factor_a double, planes_b array<long>, low_b double, step_b double, total_b double, cos double")
    out = np.array(df.select(*vectors.estimate(6), "cos").collect())
    error = out[:, 0] - out[:, 2]
    assert abs(error.mean()) < 0.004 and (np.abs(error) <= out[:, 1]).mean() > 0.999 and error.std() < 0.08
    bits, bands = vectors.banding(1_000_000, 0.9, 0.002)
    assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** bands >= 0.998


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return w


@pytest.mark.parametrize("tile, few", [(512, 48), (7, 3)])
def test_documents_against_all_pairs(spark, monkeypatch, tile, few):
    monkeypatch.setattr(nearcopies, "CLUSTER_TILE", tile)
    monkeypatch.setattr(nearcopies, "TILE", tile)
    monkeypatch.setattr(nearcopies, "FEW", few)
    r = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([30, 120, 400]))]
        for _ in range(r.choice([1, 3, 25])):
            w = edited(r, base, r.choice([0, 0, 1, 1, 2, 3, 5]))
            rows.append((len(rows), " ".join(x.upper() if r.random() < 0.1 else x for x in w).replace(" w1", "\n\tw1"), "en"))
    chain = [f"c{k}" for k in range(200)]
    for k in range(12):
        rows.append((len(rows), " ".join(chain), "en"))
        chain[10 * k + 5] = f"new{k}"
    n = len(rows)
    rows += [(n, None, None), (n + 1, "", ""), (n + 2, " \n\t", ""), (n + 3, "one two", ""), (n + 4, "ONE  two", ""), (n + 5, "two one", ""), (n + 6, "long " * 100_000, ""), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    s = {k: sets(t) for k, t, _ in rows}
    links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])]
    comp = labels(s, links)
    got = nearcopies.near_copies(df).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got} == {(k, len(s[k]), comp[k], comp[k] == k) for k in s}


def test_document_edges(spark):
    schema = "doc_id long, text string"
    assert nearcopies.near_copies(spark.createDataFrame([], schema)).count() == 0
    got = nearcopies.near_copies(spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, bool(r.kept)) for r in got) == [(0, 0, False), (0, 0, False), (4, 4, True), (5, 4, False)]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 64, 500, np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (nearcopies.registers(both) == np.maximum(nearcopies.registers(a), nearcopies.registers(b))).all()
    x, y = np.concatenate([a, b[:40]]), np.concatenate([a, b[40:80]])
    one = lambda s: nearcopies.registers(s)[None]
    n = lambda s: np.array([len(s)])
    assert nearcopies.plausible(one(x), one(y), n(x), n(y), 0.85)[0] and not nearcopies.plausible(one(a), one(b), n(a), n(b), 0.85)[0]

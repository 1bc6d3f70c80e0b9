"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is padded and rotated at random; its code is the signs, and its correction factor f the inner product of
the rotated vector with its code's direction. <code a, b> / f_a estimates the cosine without bias, with an error whose
spread follows from the factor, so a confidence bound tells which pairs can reach the threshold; only these are computed
exactly. The other side b is rounded at random to 4 bits a coordinate, as bit-planes, so an estimate is a few bit counts.
Signs of further random directions, in bands, tell which pairs meet at all; the first words of both codes, whose
differing bits have a binomial spread, then tell which of them are worth an estimate. Band rows carry no more than these.

Vectors that lie within half the threshold's angle of a leader form a ball: by the triangle inequality all its pairs
link, and are counted, not listed. Balls take the place of vectors from there on. For two balls the exact angle of the
centres often decides all pairs at once; only if it does not are the members multiplied, a block of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import components, table, written

THRESHOLD = 0.9
#: share of the pairs at the threshold itself that no band may bring together
MISSED = 0.002
#: spreads of the estimate's error that the bound allows
SPREADS = 4.0
WORDS = 4  # of 64 bits in a code, at least
PLANES = 4  # bits of a coordinate on the rounded side
SKETCH = 2  # words of the code in a band row
PREFIX = 12  # bits of the code that members of a ball share
EPS = 1e-9


@lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """Rows of a random orthogonal matrix for vectors of this length, padded to whole words."""
    size = max(WORDS * 64, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:dim]


def banding(count: int, threshold: float, missed: float) -> tuple[int, int]:
    """Bits in a band, which grow with the number of vectors, and bands for the same recall at every size."""
    bits = min(30, max(8, round(math.log2(max(2, count))) - 4))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - hit))


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(4)
def directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([dim, 1]).standard_normal((dim, n))


def words_of(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).view(np.int64)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (64-bit words) and correction factors of unit vectors."""
    y = x @ rotation(x.shape[1])
    return words_of(y > 0), np.abs(y).sum(axis=1) / math.sqrt(y.shape[1])


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, rotated, on a grid of 2^PLANES steps each: words of the bit-planes (plane by plane), lowest, step, sum."""
    y = x @ rotation(x.shape[1])
    low = y.min(axis=1, keepdims=True)
    step = np.maximum((y.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
    u = np.clip(np.floor((y - low) / step + np.random.default_rng(len(x)).random(y.shape)), 0, 2**PLANES - 1).astype(np.int64)
    planes = np.concatenate([words_of((u >> j & 1).astype(bool)) for j in range(PLANES)], axis=1)
    return planes, low[:, 0], step[:, 0], (low + step * u).sum(axis=1)


def estimate(words: int):
    """Columns of a and b: the unbiased estimate of their cosine, and the bound of its error."""
    size = F.size("words_a") * 64
    word = lambda k: F.get("words_a", F.lit(k))
    wide = F.size("words_a")
    plane = lambda j: sum((F.coalesce(F.bit_count(word(k).bitwiseAND(F.get("planes_b", wide * j + k))), F.lit(0)) for k in range(1, words)), F.bit_count(word(0).bitwiseAND(F.get("planes_b", wide * j))))
    inner = sum((plane(j) * 2**j for j in range(1, PLANES)), plane(0))
    ones = sum((F.coalesce(F.bit_count(word(k)), F.lit(0)) for k in range(1, words)), F.bit_count(word(0)))
    f = F.col("factor_a")
    value = (2 * (F.col("low_b") * ones + F.col("step_b") * inner) - F.col("total_b")) / F.sqrt(size) / f
    # rounding at random has a spread of step / sqrt(6) on average
    slack = SPREADS * F.sqrt((1 - f * f) / (f * f) / (size - 1) + (F.col("step_b") / f) ** 2 / 6)
    return value, slack


def band_keys(x: np.ndarray, bits: int, bands: int, block: int = 32) -> np.ndarray:
    """Band keys of unit vectors, some bands at a time."""
    dim = x.shape[1]
    out = np.empty((len(x), bands), np.int64)
    spread = directions(dim, bits * bands)
    for k in range(0, bands, block):
        n = min(block, bands - k)
        signs = (x @ spread[:, k * bits : (k + n) * bits] > 0).reshape(len(x), n, bits)
        out[:, k : k + n] = (signs << np.arange(bits)).sum(axis=2) + (np.arange(k, k + n) << 32) + (dim << 48)
    return out


def sketch_bound(threshold: float):
    """Columns of a and b: whether so few bits of the first words differ that the angle may be the balls' reach."""
    p = F.least(F.lit(1.0), (F.lit(math.acos(threshold)) + F.col("radius_a") + F.col("radius_b")) / math.pi)
    differ = sum((F.bit_count(F.col(f"sketch{k}_a").bitwiseXOR(F.col(f"sketch{k}_b"))) for k in range(1, SKETCH)), F.bit_count(F.col("sketch0_a").bitwiseXOR(F.col("sketch0_b"))))
    size = 64 * SKETCH
    return differ <= size * p + SPREADS * F.sqrt(size * p * (1 - p))


def coder() -> Callable:
    """Every row: uid, id; of valid vectors also dim, vector (float64 bytes) and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            valid = np.zeros(batch.num_rows, bool)
            dims = np.array([0 if v is None else v for v in pc.list_value_length(column).to_pylist()])
            for dim in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == dim)
                flat = column.take(pa.array(at)).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                ok = np.isfinite(x).all(axis=1)
                top = np.abs(np.where(np.isfinite(x), x, 0)).max(axis=1, keepdims=True)
                ok &= top[:, 0] > 0
                at, x = at[ok], (x / np.where(top > 0, top, 1))[ok]
                if not len(at):
                    continue
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                word, _ = codes(x)
                valid[at] = True
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").take(rows), batch.column("id").take(rows), pa.array(np.full(len(at), dim, np.int32)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(word[:, 0].copy())],
                    ["uid", "id", "dim", "vector", "code"],
                )
            rest = batch.filter(pa.array(~valid))
            if rest.num_rows:
                nulls = [pa.nulls(rest.num_rows, t) for t in (pa.int32(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([rest.column("uid"), rest.column("id"), *nulls], ["uid", "id", "dim", "vector", "code"])

    return run


BALL = "uid long, id long, ball long, dim int, size long, radius double, factor double, words array<long>, planes array<long>, low double, step double, total double, centre binary, uids array<long>, vectors binary, least long, keys array<long>"


def ball_maker(threshold: float, bits: int, bands: int) -> Callable:
    """Vectors sorted by code to balls, a batch at a time; a ball's own columns, and the different band keys of all its
    members, stand in its leader's row."""
    near = math.cos(math.acos(threshold) / 2) + EPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims, code = batch.column("dim").to_numpy(), batch.column("code").to_numpy() >> (64 - PREFIX)
            uid, raw = batch.column("uid").to_numpy(), batch.column("vector").to_pylist()
            ids = batch.column("id").to_pylist()
            leader = np.full(n, -1)
            cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (dims[1:] != dims[:-1])]) if n else []
            info: dict[int, tuple] = {}
            for a, b in zip(cuts, np.append(cuts[1:], n)):
                x = np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, -1)
                keys = band_keys(x, bits, bands)
                left = np.arange(b - a)
                while len(left):
                    inside = x[left] @ x[left[0]] >= near
                    inside[0] = True
                    mine = left[inside]
                    leader[a + mine] = a + left[0]
                    centre = x[mine].mean(axis=0) if len(mine) > 1 else x[mine[0]]
                    centre = centre / np.linalg.norm(centre) if len(mine) > 1 else centre
                    radius = float(np.arccos(np.clip((x[mine] @ centre).min(), -1, 1))) + EPS if len(mine) > 1 else 0.0
                    known = [ids[a + k] for k in mine if ids[a + k] is not None]
                    info[a + left[0]] = (len(mine), radius, centre, uid[a + mine].tolist(), x[mine].tobytes(), min(known, default=None), np.unique(keys[mine]).tolist())
                    left = left[~inside]
            # the centres' codes, all of a length at once
            for dim in np.unique(dims[list(info)]) if info else ():
                at = [k for k in info if dims[k] == dim]
                centres = np.stack([info[k][2] for k in at])
                word, factor = codes(centres)
                for k, f, w, *q in zip(at, factor.tolist(), word.tolist(), *(v.tolist() for v in rounded(centres))):
                    n_, r, c, u, v, *own = info[k]
                    info[k] = (n_, r, f, w, *q, c.tobytes(), u, v, *own)
            more = [info.get(k, (None,) * 13) for k in range(n)]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("id"), pa.array(uid[leader]), batch.column("dim"), *(pa.array([m[k] for m in more], t) for k, t in enumerate(kinds))],
                ["uid", "id", "ball", "dim", "size", "radius", "factor", "words", "planes", "low", "step", "total", "centre", "uids", "vectors", "least", "keys"],
            )

    return run


def judge(threshold: float) -> Callable:
    """Exact verdict on pairs of balls by their centres: all pairs link, or only the members can tell."""
    theta = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b = t.column("centre_a").to_pylist(), t.column("centre_b").to_pylist()
            cos = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in zip(a, b)])
            spread = t.column("radius_a").to_numpy() + t.column("radius_b").to_numpy()
            angle = np.arccos(np.clip(cos, -1, 1))
            single = spread == 0
            sure = np.where(single, cos >= threshold, angle + spread <= theta - EPS)
            open_ = ~single & ~sure & (angle - spread <= theta + EPS)
            keep = pa.array(sure | open_)
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep), t.column("size_a").filter(keep), t.column("size_b").filter(keep), pa.array(sure).filter(keep)], ["a", "b", "size_a", "size_b", "sure"])

    return run


def multiplier(threshold: float, block: int = 2048) -> Callable:
    """Links of each member of one ball into the other, and back, for pairs of balls that the centres leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for r in t.to_pylist():
                x, y = (np.frombuffer(r[k], np.float64).reshape(len(r[u]), -1) for k, u in (("vectors_a", "uids_a"), ("vectors_b", "uids_b")))
                na, nb = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                for k in range(0, len(x), block):
                    hit = x[k : k + block] @ y.T >= threshold
                    na[k : k + block] += hit.sum(axis=1)
                    nb += hit.sum(axis=0)
                n = np.concatenate([na, nb])
                uids = np.concatenate([r["uids_a"], r["uids_b"]])[n > 0]
                k = int((n > 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, r["a"])), pa.array(np.full(k, r["b"])), pa.array(uids, pa.int64()), pa.array(n[n > 0])], ["a", "b", "uid", "n"])

    return run


def vector_links(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, missed: float = MISSED) -> DataFrame:
    """(id column, n_links, component_id, kept) for each row: cosine >= threshold in double precision links two rows.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of different lengths, link
    with nothing. Repeated rows and equal vectors are different vectors that link with each other. component_id is the
    smallest id reachable (a null id reaches others but names nothing); kept says whether it is the row's own.
    """
    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    coded = written(source.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(coder(), "uid long, id long, dim int, vector binary, code long"), "codes")
    valid = coded.where("dim IS NOT NULL")
    count, widest = valid.agg(F.count("*"), F.max("dim")).first()
    bits, bands = banding(count, threshold, missed)
    parts = max(1, -(-count // 20_000))
    ordered = valid.repartitionByRange(parts, "dim", "code", "uid").sortWithinPartitions("dim", "code", "uid")
    members = written(ordered.mapInArrow(ball_maker(threshold, bits, bands), BALL), "balls")
    balls = members.where("size IS NOT NULL").drop("uid", "id")

    # the sides have the same columns in the same order, so that both read one shuffle of band rows
    held = balls.select("ball", "radius", *(F.get("words", F.lit(k)).alias(f"sketch{k}") for k in range(SKETCH)), F.explode("keys").alias("key"))
    side = lambda x: held.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("ball", "radius", *(f"sketch{k}" for k in range(SKETCH)))))
    met = side("a").join(side("b"), "key").where((F.col("ball_a") < F.col("ball_b")) & sketch_bound(threshold))
    met = written(met.select(F.col("ball_a").alias("a"), F.col("ball_b").alias("b")).distinct(), "met")
    value, slack = estimate(max(WORDS, -(-(widest or 0) // 64)))
    reach = F.least(F.lit(math.pi), F.lit(math.acos(threshold)) + F.col("radius_a") + F.col("radius_b"))
    end = lambda x, *cols: balls.select(F.col("ball").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in cols))
    near = met.join(end("a", "radius", "factor", "words"), "a").join(end("b", "radius", "planes", "low", "step", "total"), "b").where(value + slack >= F.cos(reach))
    near = written(near.select("a", "b"), "near")
    near = near.join(end("a", "size", "radius", "centre"), "a").join(end("b", "size", "radius", "centre"), "b")
    judged = written(near.mapInArrow(judge(threshold), "a long, b long, size_a long, size_b long, sure boolean"), "judged")
    sure = judged.where("sure")
    blob = lambda x: balls.select(F.col("ball").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("uids", "vectors")))
    mixed = judged.where("NOT sure").select("a", "b").join(blob("a"), "a").join(blob("b"), "b").mapInArrow(multiplier(threshold), "a long, b long, uid long, n long")
    mixed = written(mixed, "mixed")

    edges = sure.select("a", "b").union(mixed.select("a", "b").distinct())
    label = components(edges).toDF("ball", "component")
    by_ball = sure.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).union(sure.select("b", "size_a")).groupBy("ball").agg(F.sum("n").alias("ball_links"))
    by_uid = mixed.groupBy("uid").agg(F.sum("n").alias("own_links"))
    placed = balls.select("ball", "size", "least").join(label, "ball", "left").withColumn("component", F.coalesce("component", "ball")).join(by_ball, "ball", "left")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "component").select("ball", "size", "ball_links", "component_id")
    found = members.select("uid", "ball").join(placed, "ball").join(by_uid, "uid", "left")
    found = found.select("uid", (F.col("size") - 1 + F.coalesce("ball_links", F.lit(0)) + F.coalesce("own_links", F.lit(0))).alias("n_links"), "component_id")
    out = coded.select("uid", "id").join(found, "uid", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op1_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

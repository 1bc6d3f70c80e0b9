"""Near-duplicate documents with SetSketch registers.

A document's set holds its distinct 5-word shingles. Register i is the smallest of the set's i-th exponential hashes,
truncated to powers of BASE: K = floor(1 - log_b(h)). Registers of a union are maxima of registers, and two sets agree
in a register with a probability that follows their similarity, so bands of registers find candidates. For a
candidate, the numbers of registers that are larger, smaller and equal, with the known set sizes, give the joint
likelihood of a similarity; a pair whose likelihood at the threshold is far below that of a smaller similarity is
dropped, and every other pair is verified on the full sets.

Documents with equal sets are one node from the start. Large groups are dealt to tiles of bounded size, and what a group
has in common is found in two steps, for buckets on the registers and then for clusters on the full texts. First each
tile holds its own members and the group's smallest one; pairs that hang together already are not looked at again. What
the first step has connected is one part; in the second step, only tiles of different parts meet. So a group of n copies
costs about n rows and n comparisons, not n^2, and no link is lost. Links leave a tile as trees, not as pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.bpe import ragged
from ruleloom.llm.common import LOWER, components, mix, pieces, table, texts, written

SHINGLE = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE, RATE = 1.001, 20.0
#: documents in a tile of a bucket, documents and shingles in a tile of a cluster; buckets of so few list all their pairs
TILE, CLUSTER_TILE, TILE_SHINGLES, FEW = 1024, 512, 200_000, 48
#: a pair is dropped if some smaller similarity is more likely than the threshold by this log-likelihood ratio
DOUBT = 9.0
#: ids that may be broadcast (8 bytes each) to pick the texts to verify; beyond it, a shuffled join picks them
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20)
BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
ODD = _rng.integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
MULTIPLIERS = _rng.integers(0, 1 << 64, REGISTERS, np.uint64) | np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (A-Z lower-cased, parted by white space), and how many each text has."""
    lists = [x.translate(LOWER).split() for x in items]
    counts = np.array([len(w) for w in lists], np.int64)
    words = [w for x in lists for w in x]
    if not words:
        return np.zeros(0, np.uint64), counts
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(size.max()), POWER))
        terms = BYTE[data] * power[np.arange(len(data)) - np.repeat(starts, size)]
        return mix(np.add.reduceat(terms, starts) + size.astype(np.uint64)), counts


def shingle_sets(items: list[bytes]) -> list[np.ndarray]:
    """Each text's set: sorted 64-bit hashes of its distinct shingles; fewer words than a shingle make one."""
    w, counts = word_hashes(items)
    ends = np.cumsum(counts)
    out = []
    with np.errstate(over="ignore"):
        n = len(w) - SHINGLE + 1
        full = sum((w[k : k + n] * ODD[k] for k in range(1, SHINGLE)), w[:n] * ODD[0]) if n > 0 else w[:0]
        full = mix(full + np.uint64(SHINGLE))
        for a, b in zip((ends - counts).tolist(), ends.tolist()):
            if b - a >= SHINGLE:
                out.append(np.unique(full[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(mix((w[a:b] * ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(w[:0])
    return out


def registers(s: np.ndarray, step: int = 4096) -> np.ndarray:
    """SetSketch registers (uint16) of a set that is not empty; those of a union are the maxima."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), step):
        low = np.minimum(low, (s[a : a + step, None] * MULTIPLIERS).min(axis=0))
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65535).astype("<u2")


def sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "text"):
            sets = shingle_sets(texts(batch.column("text")))
            n = pa.array([len(s) for s in sets], pa.int64())
            with np.errstate(over="ignore"):
                one = np.array([mix(s).sum() for s in sets], np.uint64).view(np.int64)
                two = np.array([mix(s ^ POWER).sum() for s in sets], np.uint64).view(np.int64)
            regs = pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), n, pa.array(one), pa.array(two), regs], ["id", "n", "one", "two", "registers"])


def log_likelihood(j: np.ndarray, u: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity j, given the share u of the first set and the three register counts."""
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    a, b = p(u - (1 - u) * j), p((1 - u) - u * j)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-9, 1))


def plausible(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair's registers leave the threshold possible."""
    same = (ra == rb).sum(axis=1)
    keep = same >= REGISTERS * (threshold - 6 * (threshold * (1 - threshold) / REGISTERS) ** 0.5)
    at = np.flatnonzero(keep)
    if len(at):
        more = (ra[at] > rb[at]).sum(axis=1)
        less = REGISTERS - same[at] - more
        u = na[at] / (na[at] + nb[at])
        here = log_likelihood(threshold, u, more, less, same[at])
        best = np.max([log_likelihood(j, u, more, less, same[at]) for j in threshold * np.array([0.4, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95])], axis=0)
        keep[at] = best - here <= DOUBT
    return keep


def by_runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a run of equal `columns` ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column(c).to_numpy() for c in columns)
        other = np.flatnonzero((x != x[-1]) | (y != y[-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        ended = held and any(held[-1].column(c)[-1].as_py() != v[0] for c, v in zip(columns, (x, y)))
        if last or ended:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the runs of equal (x, y) start."""
    return np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, np.int64)


def forest(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest index that each index reaches by the pairs (i, j)."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root[i] == root[j]).all():
            return root


def tree_links(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) by which the pairs' ids hang together: one for each id at most, not one for each pair."""
    root = forest(i, j, len(ids))
    at = np.flatnonzero(ids[root] != ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[root[at]], pa.int64()), pa.array(ids[at], pa.int64())], ["a", "b"])


def parts_that_meet(comp: np.ndarray, side: np.ndarray, far: np.ndarray, check: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that check(i, js) links, i < j < far[i]; pairs whose parts hang together by then are not checked."""
    label = np.unique(comp, return_inverse=True)[1]
    found = [np.zeros((2, 0), np.int64)]
    for k in range(len(label) - 1):
        other = np.arange(k + 1, far[k])
        other = other[(label[other] != label[k]) & ((side[other] != side[k]) | (side[k] == 2))]
        if len(other):
            hit = other[check(k, other)]
            if len(hit):
                found.append(np.stack([np.full(len(hit), k), hit]))
                label[np.isin(label, label[hit])] = label[k]
    return tuple(np.concatenate(found, axis=1))


def bucket_links(threshold: float) -> Callable:
    """Sorted tiles of buckets to links by which the plausible pairs of each hang together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_runs(batches, ("key", "tile")):
            key, tile, side, ids, comp, n = (t.column(c).to_numpy() for c in ("key", "tile", "side", "id", "comp", "n"))
            regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
            new = runs(key, tile)
            count = np.diff(np.append(new, len(key)))
            start, few = np.repeat(new, count), np.repeat(count <= FEW, count)
            found = [np.zeros((2, 0), np.int64)]

            def some(i, j):
                ok = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & ((side[i] != side[j]) | (side[i] == 2)) & (comp[i] != comp[j])
                i, j = i[ok], j[ok]
                keep = plausible(regs[i], regs[j], n[i], n[j], threshold)
                return ok, keep, i, j

            # small buckets: all their pairs, many buckets at a time
            before = np.where(few, np.arange(len(key)) - start, 0)
            cuts = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(before) // 100_000])) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(cuts, np.append(cuts[1:], len(key))):
                _, keep, i, j = some(np.repeat(np.arange(a, b), before[a:b]), ragged(start[a:b], before[a:b]))
                found.append(np.stack([i[keep], j[keep]]))
            for a, m in zip(new[count > FEW].tolist(), count[count > FEW].tolist()):

                def check(k, other, a=a):
                    ok, keep, *_ = some(np.full(len(other), a + k), a + other)
                    ok[ok] = keep
                    return ok

                i, j = parts_that_meet(comp[a : a + m], side[a : a + m], np.full(m, m), check)
                found.append(np.stack([a + i, a + j]))
            yield tree_links(*np.concatenate(found, axis=1), ids)

    return run


def first_tiles(members: DataFrame, extent: DataFrame) -> DataFrame:
    """(key, tile, side, id, comp): each member in a tile of its group, and the group's smallest member in all of them."""
    own = F.array(F.pmod(F.hash("id"), F.col("n_tiles")).cast("int"))
    tile = F.when(F.col("id") == F.col("least"), F.sequence(F.lit(0), F.col("n_tiles") - 1)).otherwise(own)
    rows = members.select("key", "id").join(extent, "key")
    return rows.select("key", F.explode(tile).alias("t"), "id").select("key", F.col("t").cast("long").alias("tile"), F.lit(2).alias("side"), "id", F.col("id").alias("comp"))


def second_tiles(members: DataFrame, extent: DataFrame, part: DataFrame) -> DataFrame | None:
    """(key, tile, side, id, comp) of groups of several tiles: each pair of tiles that holds different parts, as one tile.

    part: (id, component) as the first step found it. A part that fills tiles has its own, which do not meet each other;
    smaller parts share tiles. members has a `share`: how much of a tile a member fills.
    """
    large = extent.where("n_tiles > 1").select("key")
    if large.isEmpty():
        return None
    whole = members.join(large, "key").join(part, "id", "left").select("key", "id", "share", F.coalesce("component", "id").alias("comp"))
    whole = written(whole, "large")
    parts = whole.groupBy("key", "comp").agg(F.sum("share").alias("share"), F.count("*").alias("docs"))
    several = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    parts = parts.join(several, "key").withColumn("pure", F.col("share") >= 1).withColumn("of", F.when(F.col("pure"), F.col("comp")).otherwise(0))
    spaces = parts.groupBy("key", "pure", "of").agg(F.least(F.sum("docs"), F.ceil(F.sum("share"))).cast("int").alias("n_tiles"))
    parts, spaces = written(parts.select("key", "comp", "pure", "of"), "parts"), written(spaces, "spaces")
    one = spaces.select("key", "pure", "of", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("k")).select("key", F.struct("pure", "of", "k").alias("t"))
    two = one.toDF("key", "u")
    pairs = one.join(two, "key").where("t <= u AND NOT (t.pure AND u.pure AND t.of = u.of)").withColumn("tile", F.monotonically_increasing_id())
    pairs = written(pairs, "pairs")
    placed = whole.join(parts, ["key", "comp"]).join(spaces, ["key", "pure", "of"])
    placed = written(placed.select("key", "id", "comp", F.struct("pure", "of", F.pmod(F.hash("id"), F.col("n_tiles")).cast("int").alias("k")).alias("at")), "placed")
    left = placed.join(pairs.withColumnRenamed("t", "at"), ["key", "at"]).select("key", "tile", F.when(F.col("at") == F.col("u"), 2).otherwise(0).alias("side"), "id", "comp")
    right = placed.join(pairs.where("t <> u").withColumnRenamed("u", "at"), ["key", "at"]).select("key", "tile", F.lit(1).alias("side"), "id", "comp")
    return left.unionByName(right)


def exact_links(percent: int) -> Callable:
    """Sorted tiles of clusters to links by which their similar pairs hang together, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_runs(batches, ("key", "tile")):
            sets = [s for b in t.to_batches() for piece in pieces(b, "text") for s in shingle_sets(texts(piece.column("text")))]
            key, tile, side, ids, comp = (t.column(c).to_numpy() for c in ("key", "tile", "side", "id", "comp"))
            new = runs(key, tile)
            for a, b in zip(new, np.append(new[1:], len(key))):
                at = np.array(sorted((k for k in range(a, b) if len(sets[k])), key=lambda k: len(sets[k])), np.int64)
                if len(at) < 2:
                    continue
                size = np.array([len(sets[k]) for k in at])
                known, flat = np.unique(np.concatenate([sets[k] for k in at]), return_inverse=True)
                ends = np.cumsum(size)
                mark = np.zeros(len(known), np.int32)
                far = np.searchsorted(size, size * 100 // percent, side="right")  # a larger set is too large

                def check(k, other):
                    own = flat[ends[k] - size[k] : ends[k]]
                    mark[own] = 1
                    inside = mark[flat[ragged(ends[other] - size[other], size[other])]]
                    both = np.add.reduceat(inside, np.cumsum(size[other]) - size[other])
                    mark[own] = 0
                    return 100 * both >= percent * (size[k] + size[other] - both)

                yield tree_links(*parts_that_meet(comp[at], side[at], far, check), ids[at])

    return run


def near_copies(docs: DataFrame, id_column: str = "doc_id", percent: int = 85) -> DataFrame:
    """(id column, n_shingles, component_id, kept) for each row of docs.

    Rows link if 100 * intersection >= percent * union of their sets (of 64-bit hashes of the shingles); component_id is the smallest id reachable, kept
    says whether it is the row's own. Text that is null or has no words has an empty set and links with nothing.
    Repeated rows and equal texts are one node. Rows that share an id count as one document for links, each with its own
    n_shingles; a null id stands apart and gets a null component. Other columns are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), "text")
    sketches = written(source.mapInArrow(sketcher, "id long, n long, one long, two long, registers binary"), "sketches")
    some = sketches.where("n > 0 AND id IS NOT NULL")
    nodes = written(some.groupBy("one", "two", "n").agg(F.min("id").alias("id"), F.first("registers").alias("registers")), "nodes")
    band = lambda k: F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS))
    bands = nodes.select("id", F.explode(F.array(*[band(k) for k in range(BANDS)])).alias("key"), F.lit(1 / TILE).alias("share"))

    def joined(tiles: DataFrame, payload: DataFrame, links_of: Callable) -> DataFrame:
        rows = tiles.join(payload, "id").repartition("key", "tile").sortWithinPartitions("key", "tile")
        return rows.mapInArrow(links_of, "a long, b long").distinct()

    def linked(members: DataFrame, extent: DataFrame, payload: DataFrame, links_of: Callable, label: str) -> DataFrame:
        """Components (id, component) of all links in the groups: in their tiles first, then between the parts that remain."""
        first = written(joined(first_tiles(members, extent), payload, links_of), label)
        part = components(first)
        more = second_tiles(members, extent, part)
        if more is None:
            return part
        second = written(joined(more, payload, links_of), label)
        return part if second.isEmpty() else components(first.union(second))

    extent = bands.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("docs")).where("docs > 1")
    extent = written(extent.select("key", "least", F.ceil(F.col("docs") / TILE).cast("int").alias("n_tiles")), "buckets")
    buckets = nodes.select("id", "n", "registers")
    near = linked(bands, extent, buckets, bucket_links(percent / 100), "near")

    # what hangs together by plausible pairs is a cluster, whose pairs are verified on the full sets
    cluster = near.withColumnRenamed("component", "key").join(nodes.groupBy("id").agg(F.sum("n").alias("n")), "id")
    cluster = written(cluster.select("id", "key", F.least(F.lit(1.0), F.greatest(F.lit(1 / CLUSTER_TILE), F.col("n") / TILE_SHINGLES)).alias("share")), "cluster")
    extent = cluster.groupBy("key").agg(F.min("id").alias("least"), F.least(F.count("*"), F.ceil(F.sum("share"))).cast("int").alias("n_tiles"))
    extent = written(extent, "extent")
    small = cluster.count() <= BROADCAST_IDS
    ids = cluster.select("id")
    held = written(source.join(F.broadcast(ids) if small else ids, "id").dropDuplicates(["id", "text"]), "texts")
    whole = linked(cluster, extent, held, exact_links(percent), "links")
    of = nodes.select("one", "two", "n", F.col("id").alias("node")).join(whole.withColumnRenamed("id", "node"), "node", "left").select("one", "two", "n", F.coalesce("component", "node").alias("component"))
    out = sketches.select("id", "n", "one", "two").join(of, ["one", "two", "n"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"), (component == F.col("id")).alias("kept"))


def op7_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{20}\\x{09}-\\x{0D}]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

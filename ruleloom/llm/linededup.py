"""Line dedup with a sharded minimal perfect hash.

First pass: a 128-bit hash of every key line of a document, once for each document, counted by key. The keys that
enough documents hold are dealt to shards; each shard is a minimal perfect hash (levels of bit vectors with ranks) over
its keys that indexes compact arrays: a 64-bit fingerprint, the document count and the largest document id.
Second pass: documents probe these arrays line by line; there is no join of lines with documents. An index beyond what
executors should hold stays in its written shards: then the lines' hashes, not the texts, go to the shards.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import LOWER, WHITE, drop, kept, mix, once, pieces, shaped, table, texts, written

MIN_LENGTH = 40
MIN_DOCS = 5
#: keys in a shard, and bytes of shards that executors hold all together; beyond it the lines' hashes go to the shards
SHARD_KEYS = 1 << 18
INDEX_BYTES = 64 << 20
BYTES_A_KEY = 30
#: line hashes that probe a shard in one task; the shards of frequent lines are copied to several
PROBES = 1 << 20
GAMMA = 2.0


def key_hash(line: bytes, min_length: int) -> bytes | None:
    """128-bit hash of the line's key; None if the key is shorter than `min_length` code points."""
    key = line.strip(WHITE)
    if len(key) < min_length or len(key) < 4 * min_length and len(key.decode()) < min_length:
        return None
    import xxhash

    return xxhash.xxh3_128_digest(key.translate(LOWER))


def keys(min_length: int) -> Callable:
    """(hi, lo, doc_id) for each different key line of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                found: list[bytes] = []
                owner: list[int] = []
                for k, text in enumerate(texts(batch.column("text"))):
                    mine = {key_hash(line, min_length) for line in text.split(b"\n")}
                    mine.discard(None)
                    found.extend(mine)
                    owner.extend([k] * len(mine))
                h = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("id").take(pa.array(owner, pa.int64()))], ["hi", "lo", "id"])

    return run


def build_mph(hi: np.ndarray, lo: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bit vectors (uint64 words) over different keys (hi, lo), and each key's index in 0 .. n - 1.

    Every level hashes both halves anew, so keys that share a half, or a place in one level, part in a later one.
    """
    levels, index, left, base = [], np.zeros(len(hi), np.int64), np.arange(len(hi)), 0
    while len(left):
        size = max(64, int(GAMMA * len(left)) + 63 & ~63)
        at = place(hi[left], lo[left], len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        bits = np.packbits(alone, bitorder="little").view(np.uint64)
        rank = np.cumsum(alone) - alone
        hit = alone[at]
        index[left[hit]] = base + rank[at[hit]]
        base += int(alone.sum())
        levels.append(bits)
        left = left[~hit]
    return levels, index


def place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = (0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        one = mix(hi.view(np.uint64) + np.uint64(salt))
        return (mix(one ^ (lo.view(np.uint64) * np.uint64(salt | 1))) % np.uint64(size)).astype(np.int64)


class Shard:
    """One shard, ready to be probed."""

    def __init__(self, row: dict):
        words = np.frombuffer(row["bits"], np.uint64)
        self.sizes = row["sizes"]
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
        self.words, self.total = words, int(bits.sum())
        self.fingerprint, self.largest = np.frombuffer(row["fingerprints"], np.int64), np.frombuffer(row["largest"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Index of each key, or -1 for keys that are not in the shard."""
        out, left, base = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = place(hi[left], lo[left], level, size) + base
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.rank[at[hit] >> 6] + below
            left, base = left[~hit], base + size
        known = out >= 0
        out[known] = np.where(self.fingerprint[out[known]] == lo[known], out[known], -1)
        return out


def number(id_column: str):
    return F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("id")


def shard_of(hi: np.ndarray, n: int) -> np.ndarray:
    return (mix(hi.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def deal(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column("hi").to_numpy(zero_copy_only=False), n)), *b.columns], ["shard", *b.schema.names])

    return run


def build_shard(t: pa.Table) -> pa.Table:
    hi = t.column("hi").to_numpy()
    levels, index = build_mph(hi, t.column("lo").to_numpy())
    order = np.argsort(index)
    arrays = {c: pa.array([t.column(c).to_numpy()[order].astype(np.int64).tobytes()], pa.binary()) for c in ("lo", "n", "largest")}
    return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "sizes": pa.array([[64 * len(x) for x in levels]], pa.list_(pa.int64())), "bits": pa.array([np.concatenate(levels).tobytes()], pa.binary()), "fingerprints": arrays["lo"], "counts": arrays["n"], "largest": arrays["largest"]})


SHARD_SCHEMA = "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary, largest binary"


def build_index(docs: DataFrame, id_column: str, min_length: int, min_docs: int, shard_keys: int) -> tuple[DataFrame, int, int]:
    """The shards as a written table, their number, and the number of keys."""
    seen = docs.select(number(id_column), "text").mapInArrow(keys(min_length), "hi long, lo long, id long")
    often = seen.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("id").alias("largest")).where(F.col("n") >= min_docs)
    often = written(often, "lines")
    count = often.count()
    n = max(1, -(-count // shard_keys))
    shards = often.mapInArrow(deal(n), "shard long, hi long, lo long, n long, largest long").groupBy("shard").applyInArrow(build_shard, SHARD_SCHEMA)
    shards = written(shards, "shards")
    drop(often)
    return shards, n, count


def hashes(lines: list[list[bytes]], min_length: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Hash halves of all key lines of the texts, and (text, line) of each."""
    found, where = [], []
    for k, x in enumerate(lines):
        for j, line in enumerate(x):
            h = key_hash(line, min_length)
            if h is not None:
                found.append(h)
                where.append((k, j))
    h = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
    return h[:, 0].copy(), h[:, 1].copy(), where


TEXT, DIGEST = "n_lines long, n_dropped long, text string", "n_lines long, n_dropped long, kept_sha256 string"


def kept_lines(batch: pa.RecordBatch, n_kept: int, lines: list[list[bytes]], masks: list[np.ndarray], digest: bool) -> pa.RecordBatch:
    left = [b"\n".join([y for y, m in zip(x, gone) if not m]) for x, gone in zip(lines, masks)]
    n_lines, dropped = pa.array([len(x) for x in lines], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64())
    last = pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()) if digest else pa.array(left, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns[:n_kept], n_lines, dropped, last], [*batch.schema.names[:n_kept], "n_lines", "n_dropped", "kept_sha256" if digest else "text"])


def prober(share, n: int, min_length: int, digest: bool) -> Callable:
    """Drops the lines that the shards tell to drop. The last two columns are id and text; the others are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = share.value
        shards = once(("lines", name), lambda: {r["shard"]: Shard(r) for r in rows})
        for whole in batches:
            rest = whole.num_columns - 2
            for batch in pieces(whole, rest + 1):
                lines = [t.split(b"\n") for t in texts(batch.column(rest + 1))]
                masks = [np.zeros(len(x), bool) for x in lines]
                ids = batch.column(rest).to_pylist()
                hi, lo, where = hashes(lines, min_length)
                of = shard_of(hi, n)
                for s in np.unique(of):
                    if s in shards:
                        mine = np.flatnonzero(of == s)
                        at = shards[s].find(hi[mine], lo[mine])
                        for i, a in zip(mine[at >= 0].tolist(), at[at >= 0].tolist()):
                            k, j = where[i]
                            masks[k][j] = ids[k] != shards[s].largest[a]
                yield kept_lines(batch, rest, lines, masks, digest)

    return run


def lister(n: int, min_length: int) -> Callable:
    """(row, line, shard, hi, lo, id) of all key lines of (row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 2):
                hi, lo, where = hashes([t.split(b"\n") for t in texts(batch.column(2))], min_length)
                k, j = np.array(where, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(j), pa.array(shard_of(hi, n)), pa.array(hi), pa.array(lo), batch.column(1).take(pa.array(k))], ["row", "line", "shard", "hi", "lo", "id"])

    return run


def probe_shard(lines: pa.Table, shard: pa.Table) -> pa.Table:
    """(row, line) of the lines that a shard tells to drop."""
    if not shard.num_rows or not lines.num_rows:
        return pa.table({"row": pa.array([], pa.int64()), "line": pa.array([], pa.int64())})
    s = Shard(shard.select(["sizes", "bits", "fingerprints", "counts", "largest"]).to_pylist()[0])
    at = s.find(lines.column("hi").to_numpy().copy(), lines.column("lo").to_numpy().copy())
    gone = (at >= 0) & (s.largest[np.maximum(at, 0)] != lines.column("id").to_numpy())
    return lines.select(["row", "line"]).filter(pa.array(gone))


def dropper(digest: bool) -> Callable:
    """Drops listed lines. The last two columns are their numbers (or null) and the text; the others are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rest = whole.num_columns - 2
            for batch in pieces(whole, rest + 1):
                lines = [t.split(b"\n") for t in texts(batch.column(rest + 1))]
                masks = [np.zeros(len(x), bool) for x in lines]
                for m, gone in zip(masks, batch.column(rest).to_pylist()):
                    m[gone or []] = True
                yield kept_lines(batch, rest, lines, masks, digest)

    return run


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, digest: bool = False, shard_keys: int = SHARD_KEYS, index_bytes: int = INDEX_BYTES, probes: int = PROBES) -> DataFrame:
    """docs with repeated lines dropped: all columns, n_lines, n_dropped (digest: id column, n_lines, n_dropped, kept_sha256).

    A line's key is the line stripped of white space, A-Z lower-cased. Keys of `min_length` code points or more that
    `min_docs` rows hold lose all their lines, but in the rows with the largest id that holds the key. Null text is one
    empty line (and becomes empty); a null id counts as the smallest; repeated rows count as rows. Columns named n_lines
    or n_dropped are replaced; all others, of any name, stay as they are.

    An index of up to `index_bytes` (counted first) is broadcast. Beyond it the hashes of the key lines are dealt to the
    shards, a shard that more than `probes` of them ask being copied to several tasks, and what goes comes back by row.
    A line is told by a 128-bit hash; one that is not frequent passes a shard's check with a probability of 2^-64.
    """
    shards, n, count = build_index(docs, id_column, min_length, min_docs, shard_keys)
    outputs = DIGEST if digest else TEXT
    keep = [id_column] if digest else kept(docs.columns, outputs)
    source = docs.select(*keep, number(id_column).alias("_id"), F.col("text").alias("_text"))
    if count * BYTES_A_KEY <= index_bytes:
        share = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r.asDict() for r in shards.toLocalIterator()]))
        drop(shards)
        out = source.mapInArrow(prober(share, n, min_length, digest), shaped(docs, keep, outputs))
    else:
        rows = written(source.withColumn("_row", F.monotonically_increasing_id()), "rows")
        lines = written(rows.select("_row", "_id", "_text").mapInArrow(lister(n, min_length), "row long, line long, shard long, hi long, lo long, id long"), "probes")
        copies = written(lines.groupBy("shard").agg(F.ceil(F.count("*") / probes).alias("copies")), "copies")
        asked = lines.join(copies, "shard").withColumn("copy", F.pmod(F.hash("row", "line"), F.col("copies"))).drop("copies")
        held = shards.join(copies.toDF("of", "n"), F.col("shard") == F.col("of")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("of", "n")
        gone = asked.groupBy("shard", "copy").cogroup(held.groupBy("shard", "copy")).applyInArrow(probe_shard, "row long, line long")
        gone = gone.groupBy("row").agg(F.collect_list("line").alias("_gone"))
        out = rows.join(gone.withColumnRenamed("row", "_row"), "_row", "left").select(*keep, "_gone", "_text").mapInArrow(dropper(digest), shaped(docs, keep, outputs))
    if digest:
        return out
    return out.select(*[c for c in docs.columns if c == "text" or c in keep], "n_lines", "n_dropped")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


ORACLE = """
WITH l AS (SELECT doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
f AS (SELECT k, max(doc_id) AS largest FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, f.k IS NOT NULL AND doc_id <> largest AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

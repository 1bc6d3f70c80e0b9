"""Token ids in files of wavelet matrices.

Documents are range-partitioned by id and encoded in order; every partition writes one compressed Parquet file, whose
rows are shards of about SHARD_TOKENS ids in this format (little-endian):

    b"WVM2"  levels u32  n_symbols u64  n_docs u64  n_tokens u64
    symbols  u32[n_symbols]   the ids that occur, ascending; the matrix holds their numbers
    doc_ids  i64[n_docs]
    lengths  u64[n_docs]      ids of each document, end id included
    zeros    u64[levels]      zero bits of each plane
    planes   u64[levels][ceil(n_tokens / 64)]
    ranks    u32[levels][ceil(n_tokens / 512) + 1]   set bits of a plane before each run of 512

Plane k holds bit (levels - 1 - k) of each number, in the order that stable partitions by all earlier planes give.
Rank (a sample and at most eight words) and select on the planes give access to a token, counts of a token in a prefix, and its occurrences.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.bpe import ForcedBpe
from ruleloom.llm.common import new_path, pieces, table, texts

MAGIC = b"WVM2"
#: words between two rank samples
SAMPLE = 8
HEAD = struct.Struct("<4sIQQQ")
SHARD_TOKENS = 1 << 20
#: bytes of text a partition should hold
PARTITION_BYTES = 32 << 20
NO_ID = -(1 << 63)


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One shard of the file format."""
    present = np.flatnonzero(np.bincount(ids)) if len(ids) else np.zeros(0, np.int64)
    number = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.uint32)
    number[present] = np.arange(len(present))
    s = number[ids]
    levels = max(1, int(len(present) - 1).bit_length()) if len(present) else 0
    if levels <= 16:
        s = s.astype(np.uint16)
    zeros, planes, ranks = [], [], []
    room = -(-len(s) // 64) * 8
    for k in range(levels):
        bit = (s >> s.dtype.type(levels - 1 - k) & s.dtype.type(1)).view(np.uint8)[:: s.dtype.itemsize].astype(bool)
        planes.append(np.packbits(bit, bitorder="little").tobytes().ljust(room, b"\0"))
        each = np.bitwise_count(np.frombuffer(planes[-1], "<u8"))
        ranks.append(np.cumsum([0, *np.add.reduceat(each, np.arange(0, len(each), SAMPLE), dtype=np.int64)] if len(each) else [0]).astype("<u4").tobytes())
        ones, none = np.flatnonzero(bit), np.flatnonzero(~bit)
        zeros.append(len(none))
        if k < levels - 1:
            s = np.concatenate([s[none], s[ones]])
    head = HEAD.pack(MAGIC, levels, len(present), len(doc_ids), len(ids))
    return b"".join([head, present.astype("<u4").tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), np.array(zeros, "<u8").tobytes(), *planes, *ranks])


class Shard:
    """A shard read from its bytes."""

    def __init__(self, blob: bytes):
        magic, self.levels, n_symbols, n_docs, self.n = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        self.symbols, self.doc_ids, self.lengths, self.zeros = take("<u4", n_symbols), take("<i8", n_docs), take("<u8", n_docs).astype(np.int64), take("<u8", self.levels).astype(np.int64)
        words = -(-self.n // 64)
        self.planes = [take("<u8", words) for _ in range(self.levels)]
        self.ranks = [take("<u4", -(-words // SAMPLE) + 1).astype(np.int64) for _ in range(self.levels)]

    def ones(self, level: int, upto):
        """Set bits of a plane before each place: a stored sample, and the words from there to the place."""
        upto = np.asarray(upto, np.int64)
        run = upto >> 9
        at = run[..., None] * SAMPLE + np.arange(SAMPLE)  # the words of the run that holds the place
        plane = self.planes[level]
        word = np.where(at < len(plane), plane[np.minimum(at, len(plane) - 1)] if len(plane) else np.uint64(0), np.uint64(0))
        left = np.clip(upto[..., None] - (at << 6), 0, 64)  # bits of each word that stand before it
        mask = np.where(left == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (left & 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[level][run] + np.bitwise_count(word & mask).sum(axis=-1, dtype=np.int64)

    def access(self, places) -> np.ndarray:
        """The ids at these places."""
        at, out = np.asarray(places, np.int64), np.zeros(np.shape(places), np.int64)
        for k in range(self.levels):
            bit = (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self.ones(k, at)
            out, at = out << 1 | bit, np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return self.symbols[out].astype(np.int64)

    def _range(self, symbol: int, upto: int) -> tuple[int, int] | None:
        k = int(np.searchsorted(self.symbols, symbol))
        if k == len(self.symbols) or self.symbols[k] != symbol:
            return None
        a, b = 0, upto
        for level in range(self.levels):
            x, y = int(self.ones(level, a)), int(self.ones(level, b))
            a, b = (int(self.zeros[level]) + x, int(self.zeros[level]) + y) if k >> (self.levels - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, symbol: int, upto: int | None = None) -> int:
        """How often the id occurs before place `upto` (everywhere if None)."""
        found = self._range(symbol, self.n if upto is None else upto)
        return found[1] - found[0] if found else 0

    def occurrences(self, symbol: int) -> np.ndarray:
        """All places of the id, ascending: select, level by level from the last plane."""
        found = self._range(symbol, self.n)
        if found is None:
            return np.zeros(0, np.int64)
        at, k = np.arange(*found), int(np.searchsorted(self.symbols, symbol))
        for level in reversed(range(self.levels)):
            one = k >> (self.levels - 1 - level) & 1
            at = self.select(level, at - (self.zeros[level] if one else 0), one)
        return at

    def select(self, level: int, nth: np.ndarray, one: int) -> np.ndarray:
        """Place of the nth (from 0) bit of this kind: the run by the samples, then the word and the bit in it."""
        ranks, plane = self.ranks[level], self.planes[level]
        before = ranks if one else np.arange(len(ranks)) * 64 * SAMPLE - ranks
        run = np.searchsorted(before, nth, side="right") - 1
        at = run[:, None] * SAMPLE + np.arange(SAMPLE)
        words = np.where(at < len(plane), plane[np.minimum(at, len(plane) - 1)], np.uint64(0))
        bits = np.unpackbits(np.ascontiguousarray(words).astype("<u8").view(np.uint8), axis=1, bitorder="little") == one
        inside = np.cumsum(bits, axis=1, dtype=np.int32) == (nth - before[run] + 1)[:, None]
        return run * 64 * SAMPLE + (inside & bits).argmax(axis=1)

    def tokens(self) -> np.ndarray:
        """All ids: the stable partitions undone from the last plane to the first."""
        s = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in reversed(range(self.levels)):
            bit = np.unpackbits(self.planes[k].view(np.uint8), count=self.n, bitorder="little").view(bool)
            ones, none = np.flatnonzero(bit), np.flatnonzero(~bit)
            out = np.empty_like(s)
            out[none] = s[: len(none)]
            out[ones] = s[len(none) :] | s.dtype.type(1 << (self.levels - 1 - k))
            s = out
        return self.symbols[s]


#: parts whose prefix sums one task makes
RUN = 1024
SCHEMA = "part long, shard long, n_docs long, n_tokens long, blob binary"


def writer(path: str, end_id: int, shard_tokens: int) -> Callable:
    """Ordered documents of a partition to its shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bpe = ForcedBpe.load(path)
        ids, counts, names, held, shard = [], [], [], 0, 0

        def flush():
            blob = pack(np.concatenate(ids), np.concatenate(names), np.concatenate(counts))
            n_docs = sum(len(x) for x in names)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, shard, n_docs, held)] + [pa.array([blob], pa.binary())], ["part", "shard", "n_docs", "n_tokens", "blob"])

        for whole in batches:
            for batch in pieces(whole, "text", min(1 << 20, 2 * shard_tokens)):
                got, n = bpe.encode(texts(batch.column("text")))
                ends = np.cumsum(n)
                out = np.empty(len(got) + len(n), np.uint32)
                last = ends + np.arange(len(n))
                mask = np.ones(len(out), bool)
                mask[last] = False
                out[mask], out[last] = got, end_id
                ids.append(out)
                counts.append(n + 1)
                names.append(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64))
                held += len(out)
                if held >= shard_tokens:
                    yield flush()
                    ids, counts, names, held, shard = [], [], [], 0, shard + 1
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, id_column: str, tokenizer: str, end_id: int, where: str, partitions: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """The documents' ids, `end_id` after each, in ascending order of id, to Parquet files of shards in folder `where`.

    Null text is empty (its end id alone); a null id comes first; rows with equal ids stand by a hash of their text, so
    a hot id is spread over partitions, and repeated rows all stay. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(partitions, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    ordered.mapInArrow(writer(tokenizer, end_id, shard_tokens), SCHEMA).write.option("compression", "zstd").parquet(where)


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["blob"])
            raw = shard.tokens().astype("<u4").tobytes()
            ends = np.cumsum(shard.lengths)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - shard.lengths).tolist(), ends.tolist())]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["part"])), pa.array(np.full(n, row["shard"])), pa.array(np.arange(n)), pa.array(shard.doc_ids), pa.array(ends - shard.lengths), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                ["part", "shard", "nth", "id", "before", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, where: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files: `start` counts the ids of all documents before."""
    files = spark.read.schema(SCHEMA).parquet(where)
    told = files.select("part", "shard", "n_tokens", F.floor(F.col("part") / RUN).alias("run"))  # one row a shard; the blobs are not read here
    # prefix sums in three steps, so that no task sees more than a run of parts, or a row a run
    upto = lambda *by: F.sum("n_tokens").over((Window.partitionBy(*by[:-1]) if by[:-1] else Window).orderBy(by[-1])) - F.col("n_tokens")
    runs = told.groupBy("run").agg(F.sum("n_tokens").alias("n_tokens")).select("run", upto("run").alias("run_first"))
    parts = told.groupBy("run", "part").agg(F.sum("n_tokens").alias("n_tokens")).select("run", "part", upto("run", "part").alias("part_first"))
    shards = told.select("run", "part", "shard", upto("run", "part", "shard").alias("shard_first"))
    first = shards.join(parts, ["run", "part"]).join(runs, "run").select("part", "shard", (F.col("run_first") + F.col("part_first") + F.col("shard_first")).alias("first"))
    docs = files.select("part", "shard", "blob").mapInArrow(reader, "part long, shard long, nth long, id long, before long, n_tokens long, ids_crc32 long")
    return docs.join(first, ["part", "shard"]).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("id"), (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(spark: SparkSession, where: str, ids: list[int]) -> DataFrame:
    """(token, n): how often each of these ids occurs in the files, by rank alone; no shard is decoded."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                shard = Shard(blob)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shard.count(x) for x in ids], pa.int64())], ["token", "n"])

    return spark.read.schema(SCHEMA).parquet(where).select("blob").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, where: str, token: int) -> DataFrame:
    """(id, place): each occurrence of the token, as a place within its document, by select alone."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                shard = Shard(blob)
                at, ends = shard.occurrences(token), np.cumsum(shard.lengths)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[doc]), pa.array(at - (ends - shard.lengths)[doc])], ["id", "place"])

    return spark.read.schema(SCHEMA).parquet(where).select("blob").mapInArrow(run, "id long, place long")


def partitions_of(docs: DataFrame, bytes_each: int = PARTITION_BYTES) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return max(1, -(-size // bytes_each))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    where = new_path(spark, "tokens")
    write_shards(docs, "doc_id", public_tokenizers.path("byte_bpe_50k.json"), 2, where, partitions_of(docs))
    return read_shards(spark, where).withColumnRenamed("id", "doc_id")

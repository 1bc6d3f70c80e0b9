"""Language identification by prediction by partial matching (PPM).

For each language, counts of byte sequences form a context tree of variable order, up to `ORDER` bytes. With frozen
counts the code length of a byte depends on its context alone: in a context seen n times with d different followers, a
follower seen c times costs -log2(c / (n + d)); any other escapes at -log2(d / (n + d)) and is coded in the next shorter
context; a context never seen is skipped at no cost; below the empty context all 256 byte values are equally likely. So
the exact code length of a text is a sum over its (ORDER + 1)-byte sequences.

A tree is kept as sorted arrays by depth: sequences with their bits, contexts with the bits of their escape. Only what
was seen is stored. The different sequences of a piece of text are looked up once each.

Texts are lower-cased and every run of other characters than letters and their marks becomes one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import drop, kept, once, pieces, shaped, table, texts, written

ORDER = 3
#: bytes of labelled text a language is learned from, and all languages together: a bounded sample, chosen by a hash
SAMPLE_BYTES, SAMPLE_TOTAL = 4_000_000, 64_000_000
#: bytes of text that are scored in one step
STEP = 1 << 19


def letters(text: Column) -> Column:
    """Lower case, with one space for every run of other characters."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def joined(items: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts, each after `order` spaces, and where each text's own bytes start and end."""
    gap = b" " * order
    sizes = np.array([len(x) for x in items], np.int64)
    ends = np.cumsum(sizes + order)
    return np.frombuffer(gap.join([b"", *items]), np.uint8), ends - sizes, ends


def grams(s: np.ndarray, width: int) -> np.ndarray:
    """Number of the sequence of `width` bytes (8 at most) that ends at each place from width - 1 on."""
    n = max(0, len(s) - width + 1)
    kind = np.uint32 if width <= 4 else np.uint64
    out = s[:n].astype(kind)
    for k in range(1, width):
        out = out << kind(8) | s[k : n + k]
    return out


def counter(order: int) -> Callable:
    """Partial counts of (lang, sequence) for each batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                items = texts(batch.column("text").filter(pa.array(langs == lang)))
                s, starts, ends = joined(items, order)
                g = grams(s, order + 1)  # g[i] ends at i + order
                own = np.zeros(len(g), bool)
                for a, b in zip(starts, ends):
                    own[a - order : b - order] = True
                keys, n = np.unique(g[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.uint64).view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return count


class Tree:
    """The context tree of one language with frozen counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int):
        self.order = order
        #: by depth k: sequences of k + 1 bytes and their bits, contexts of k bytes and the bits of their escape
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.escape: list[tuple[np.ndarray, np.ndarray]] = []
        kind = np.uint32 if order < 4 else np.uint64
        keys = keys.astype(kind)
        for k in range(order + 1):
            short = keys & kind((1 << 8 * (k + 1)) - 1)
            own, at = np.unique(short, return_inverse=True)
            count = np.bincount(at, n, len(own))
            context, of = np.unique(own >> kind(8), return_inverse=True)
            total, kinds = np.bincount(of, count, len(context)), np.bincount(of, minlength=len(context))
            self.seen.append((own, (np.log2(total + kinds)[of] - np.log2(count)).astype(np.float32)))
            self.escape.append((context, (np.log2(total + kinds) - np.log2(kinds)).astype(np.float32)))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each (order + 1)-byte sequence."""
        out, left = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for k in range(self.order, -1, -1):
            mask = keys.dtype.type((1 << 8 * (k + 1)) - 1)
            here = keys[left] & mask
            hit, at = found(self.seen[k][0], here)
            out[left[hit]] += self.seen[k][1][at[hit]]
            left, here = left[~hit], here[~hit]
            known, at = found(self.escape[k][0], here >> keys.dtype.type(8))
            out[left[known]] += self.escape[k][1][at[known]]
        out[left] += 8
        return out


def found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def learn(labelled: DataFrame, order: int = ORDER, sample_bytes: int = SAMPLE_BYTES, sample_total: int = SAMPLE_TOTAL) -> dict:
    """A model from rows (key, text, lang): the languages and the counts of byte sequences.

    About `sample_bytes` of each language's different texts are taken by a hash of `key` (less if there are more than
    sample_total / sample_bytes languages): the share follows from the language's size in bytes, so the sample and the
    model stay bounded at every size, and whole texts are counted. Rows with null text or lang are left out. Without
    labelled rows the model has no languages.
    """
    clean = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    by_lang = clean.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))
    sizes = {r["lang"]: r["size"] for r in by_lang.collect()}  # a row a language
    langs = sorted(sizes)
    each = min(sample_bytes, sample_total // max(1, len(langs)))
    share = clean.sparkSession.createDataFrame([(x, min(1.0, each / max(1, sizes[x]))) for x in langs], "lang string, share double")
    picked = clean.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    picked = written(picked.select("lang", letters(F.col("text")).alias("text")).distinct(), "langid")
    rows = picked.mapInArrow(counter(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    drop(picked)
    place = {x: k for k, x in enumerate(langs)}
    of = np.array([place[x] for x in got.column("lang").to_pylist()], np.int32)
    gram, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    trees = []
    for k in range(len(langs)):
        mine = np.flatnonzero(of == k)
        mine = mine[np.argsort(gram[mine])]
        trees.append((gram[mine].astype(np.uint32 if order < 4 else np.uint64), n[mine].astype(np.int32)))
    name = hashlib.sha256(repr((langs, order)).encode() + b"".join(a.tobytes() + b.tobytes() for a, b in trees)).hexdigest()
    return {"langs": langs, "order": order, "trees": trees, "name": name}


def trees_of(model: dict) -> list[Tree]:
    return [Tree(keys, n, model["order"]) for keys, n in model["trees"]]


def lengths(items: list[bytes], trees: list[Tree], order: int, step: int = STEP) -> np.ndarray:
    """Code length in bits of each text (rows) in each language (columns)."""
    s, starts, ends = joined(items, order)
    out = np.zeros((len(items), len(trees)))
    for a in range(order, len(s), step):
        b = min(len(s), a + step)
        told = pa.array(grams(s[a - order : b], order + 1)).dictionary_encode()
        different = told.dictionary.to_numpy()
        rows = np.stack([t.bits(different) for t in trees], axis=1)[told.indices.to_numpy(zero_copy_only=False)]
        lo, hi = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        cuts = np.stack([np.clip(starts[lo:hi], a, b), np.clip(ends[lo:hi], a, b)], axis=1) - a
        full = cuts[:, 0] < cuts[:, 1]
        if full.any():
            at = np.append(cuts[full].ravel(), len(rows))
            sums = np.add.reduceat(np.vstack([rows, np.zeros((1, rows.shape[1]), np.float32)]), at, axis=0, dtype=np.float64)
            out[np.arange(lo, hi)[full]] += sums[: 2 * full.sum() : 2]
    return out


OUTPUTS = "lang_pred string, score double"


def predictor(share) -> Callable:
    """The last two columns are the letters and whether there is one; the others are kept."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        trees = once(("langid", model["name"]), lambda: trees_of(model))
        langs = np.array([*model["langs"], "und"], object)
        n = len(model["langs"])
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 2):
                some = batch.column(batch.num_columns - 1).fill_null(False).to_numpy(zero_copy_only=False) & bool(n)
                pick, score = np.full(len(some), n), np.zeros(len(some))
                if some.any():
                    items = [x if ok else b"" for x, ok in zip(texts(batch.column(batch.num_columns - 2)), some)]
                    nats = lengths(items, trees, model["order"]) * np.log(2)
                    best = nats.argmin(axis=1)
                    weight = np.exp(nats.min(axis=1, keepdims=True) - nats)
                    pick, score = np.where(some, best, n), np.where(some, 1 / weight.sum(axis=1), 0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(langs[pick].tolist(), pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-2], "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """`keep` columns, lang_pred, score (posterior of the languages given the whole text, equal priors).

    `und` with score 0 if text is null or has no letter (marks and digits are none). Ties go to the first language in
    order of names. Repeated rows each get their row; kept columns named as an output are replaced; other columns,
    whatever their names, are not read. No shuffle.
    """
    share = docs.sparkSession.sparkContext.broadcast(model)
    keep = kept(keep, OUTPUTS)
    source = docs.select(*keep, letters(F.col("text")).alias("_letters"), F.col("text").rlike(r"\p{L}").alias("_some"))
    return source.mapInArrow(predictor(share), shaped(docs, keep, OUTPUTS))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = learn(docs.where(~F.col("held_out")).select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(docs, model, ["doc_id", "held_out"])

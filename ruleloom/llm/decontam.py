"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Texts and items become words (A-Z lower-cased; digits, letters and every code point beyond ASCII). A window is 10
consecutive item words, or a whole shorter item. Every window holds one of its item's aligned blocks of 5 words whole,
so the automaton has only these blocks (and the short items) as " w1 w2 ... ": about a node for each byte of item text,
not ten. A text is scanned once as " w1 w2 w3 ... "; a block that is met proposes the five windows that may hold it,
which are looked up by hash among the items' windows and compared word by word. Hits are word numbers, and map back to
offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import kept, mix, once, pieces, row_of, shaped, table, texts, written

#: bytes that stand in words stay (A-Z lower-cased); all others become a space
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: item text in one automaton (which takes some 60 bytes of memory for each); beyond it the items are dealt to several,
#: and each scans all texts
AUTOMATON_BYTES = 4 << 20
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Windows:
    """The automaton and the windows of a block of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.window, self.names = window, sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.ids: dict[bytes, int] = {}
        block = (window + 1) // 2
        short: dict[str, set[int]] = {}
        blocks: set[str] = set()
        flat, starts, owner = [], [], []
        for name, text in items:
            w = words(text)
            if w and len(w) < window:
                short.setdefault(self.line(w), set()).add(number[name])
            elif w:
                starts.append(len(flat) + np.arange(len(w) - window + 1))
                owner.append(np.full(len(w) - window + 1, number[name]))
                flat += [self.ids.setdefault(x, len(self.ids) + 1) for x in w]
                blocks.update(self.line(w[k : k + block]) for k in range(0, len(w) - block + 1, block))
        #: by pattern: number of bytes, whether it is a block, numbers of the short items that it is
        self.patterns = [(len(p), p in blocks, tuple(sorted(short.get(p, ())))) for p in sorted(blocks | short.keys())]
        self.auto = ahocorasick.Automaton()
        for k, p in enumerate(sorted(blocks | short.keys())):
            self.auto.add_word(p, k)
        if self.patterns:
            self.auto.make_automaton()
        self.flat = np.array(flat, np.int64)
        self.index(np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int64))

    @staticmethod
    def line(w: list[bytes]) -> str:
        return (b" " + b" ".join(w) + b" ").decode("latin-1")

    def hashes(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(sum(((ids[starts + k].astype(np.uint64) + np.uint64(1)) * self.odd[k] for k in range(self.window)), np.zeros(len(starts), np.uint64)))

    def index(self, starts: np.ndarray, owner: np.ndarray) -> None:
        """Different windows by hash: a place in `flat` that reads so, and the items that hold it."""
        for seed in range(64):  # another seed if different windows share a hash
            self.odd = np.random.default_rng(seed).integers(0, 1 << 63, self.window, np.uint64) * np.uint64(2) + np.uint64(1)
            self.hash, first, of = np.unique(self.hashes(self.flat, starts), return_index=True, return_inverse=True)
            self.place = starts[first]
            if all((self.flat[self.place[of] + k] == self.flat[starts + k]).all() for k in range(self.window)):
                break
        pairs = np.unique(np.stack([of, owner], axis=1), axis=0) if len(of) else np.zeros((0, 2), np.int64)
        self.held, self.of = np.searchsorted(pairs[:, 0], np.arange(len(self.hash) + 1)), pairs[:, 1]

    def scan(self, w: list[bytes]) -> tuple[set[int], list[tuple[int, int]]]:
        """Numbers of the items of which a window occurs, and the union of the word intervals of all occurrences."""
        names: set[int] = set()
        if not w or not self.patterns:
            return names, []
        line = b" " + b" ".join(w) + b" "
        met: list[tuple[int, int]] = list(self.auto.iter(line.decode("latin-1")))
        if not met:
            return names, []
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = np.searchsorted(gaps, [end for end, _ in met]) - 1
        length, is_block, items = zip(*(self.patterns[k] for _, k in met))
        first = np.searchsorted(gaps, np.array([end for end, _ in met]) - length + 1)
        whole = [k for k, x in enumerate(items) if x]
        names.update(n for k in whole for n in items[k])
        lo, hi = [first[whole]], [last[whole]]
        at = np.unique(first[np.array(is_block)][:, None] - np.arange((self.window + 1) // 2)) if any(is_block) else np.zeros(0, np.int64)
        at = at[(at >= 0) & (at <= len(w) - self.window)]
        if len(at):
            ids = np.array([self.ids.get(x, 0) for x in w], np.int64)
            h = self.hashes(ids, at)
            k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            ok = self.hash[k] == h
            for j in range(self.window):
                ok[ok] = self.flat[self.place[k[ok]] + j] == ids[at[ok] + j]
            for x in np.unique(k[ok]).tolist():
                names.update(self.of[self.held[x] : self.held[x + 1]].tolist())
            lo.append(at[ok])
            hi.append(at[ok] + self.window - 1)
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        return names, spans(lo, hi) if len(lo) else []


def spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of word intervals (ends inclusive), in order."""
    order = np.argsort(starts, kind="stable")
    starts, far = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > far[:-1] + 1])
    return list(zip(starts[new].tolist(), far[np.r_[new[1:] - 1, len(far) - 1]].tolist()))


OUTPUTS = "n_words long, items array<string>, hits array<struct<first:int,last:int>>"


def scanner(share, window: int) -> Callable:
    """The last column is the text; the others are kept."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = share.value
        known = once(("windows", key), lambda: Windows(items, window))
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1):
                n_words, named, hits = [], [], []
                for text in texts(batch.column(batch.num_columns - 1)):
                    w = words(text)
                    n_words.append(len(w))
                    names, found = known.scan(w)
                    named.append([known.names[k] for k in sorted(names)])
                    hits.append([{"first": a, "last": b} for a, b in found])
                more = [pa.array(n_words, pa.int64()), pa.array(named, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "n_words", "items", "hits"])

    return scan


def blocks(items: DataFrame, most: int) -> list[Callable[[], list[tuple[str, bytes]]]]:
    """What reads the items in blocks of about `most` bytes of text, a block at a time on the driver."""
    clean = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = clean.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * size // most)) if size > most else 1

    def block(k: int) -> list[tuple[str, bytes]]:
        part = clean if n == 1 else clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        return [(r["item_id"], r["text"].encode()) for r in part.collect()]

    return [partial(block, k) for k in range(n)]


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """`keep` columns of each row of docs and n_words, items (sorted names), hits (intervals of word numbers).

    Items of up to `automaton_bytes` (checked first) make one broadcast automaton: no shuffle. More make several, each
    of that size at most; each scans all texts and the hits of a row meet in one shuffle. Null text has no words; null
    items or item ids are left out; repeated item ids count as one; repeated rows of docs each stay. Kept columns named
    as an output are replaced; other columns are not read.
    """
    spark = docs.sparkSession
    keep = kept(keep, OUTPUTS)
    source = docs.select(*keep, F.col("text").alias("_text"))

    def scanned(rows: DataFrame, block: list, names: list[str]) -> DataFrame:
        named = hashlib.sha256(repr((window, block)).encode()).hexdigest()
        share = spark.sparkContext.broadcast((named, block))
        return rows.select(*names, "_text").mapInArrow(scanner(share, window), shaped(rows, names, OUTPUTS))

    dealt = blocks(items, automaton_bytes)
    if len(dealt) == 1:
        return scanned(source, dealt[0](), keep)
    # several automata: rows get a number, the hits that each finds are united by it
    rows = written(source.withColumn("_row", F.monotonically_increasing_id()), "decontam")
    out = reduce(DataFrame.unionByName, (scanned(rows, block(), ["_row"]) for block in dealt))
    merged = out.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("all"))
    union = F.aggregate(
        "all",
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(x["first"] > F.element_at(acc, -1)["last"] + 1, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last"))))),
    )
    return rows.drop("_text").join(merged.select("_row", "n_words", "items", union.alias("hits")), "_row").select(*keep, "n_words", "items", "hits")


def original_spans(text: str | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as (start, end) offsets of the original text, in code points."""
    if not hits:
        return []
    at = [m.span() for m in WORD.finditer((text or "").translate(ASCII_LOWER))]
    return [(at[a][0], at[b][1]) for a, b in hits]


def cut_hits(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs with the contaminated passages' offsets: row (all columns of docs as a struct), n_words, items, spans (start, end)."""
    found = contamination(docs.select(row_of(docs).alias("row"), "text"), items, ["row"], **options)

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def mapped(text, hits):
        import pandas as pd

        return pd.Series([[{"start": a, "end": b} for a, b in original_spans(t, [(h["first"], h["last"]) for h in x])] for t, x in zip(text, hits)])

    return found.select("row", "n_words", "items", mapped("row.text", "hits").alias("spans"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns (of any name, unchanged), that hold no window of any item."""
    found = contamination(docs.select(row_of(docs).alias("row"), "text"), items, ["row"], **options)
    return found.where(F.size("items") == 0).select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x{00}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, i FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM pos, lens WHERE i + n - 1 <= len(w)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.n = win.n AND g.k = win.k),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""

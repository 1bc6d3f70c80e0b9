"""Byte-pair encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged over, so a text may be cut there and the
fragments encoded on their own. Two more conditions keep the cuts safe for the tokenizer's own first split of a text:
the character before a cut is no white space (runs of white space are split by what follows them), and the one after it
is no apostrophe (contractions are split off only where a run begins). Special tokens count as tokens, so they are
never cut. Equal fragments are encoded once for each batch, by the tokenizers library; ids and bytes are then gathered.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import kept, once, pieces, shaped, table, texts

#: different fragments whose ids a Python worker remembers
FRAGMENTS_KEPT = 500_000


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class ForcedBpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(self.library.to_str())
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        alphabet = byte_of_char()
        vocabulary = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special} | special
        size = max(vocabulary) + 1
        tokens = [vocabulary.get(i, b"") for i in range(size)]
        inside = np.zeros(65536, bool)
        for t in tokens:
            for a, b in zip(t, t[1:]):
                inside[a << 8 | b] = True
        a, b = np.arange(65536) >> 8, np.arange(65536) & 255
        white = np.isin(a, [32, *range(9, 14), *range(28, 32)])
        self.cut = ~inside & ~white & (b != 39) & ((b < 128) | (b >= 192))
        #: (a, b) before which a further byte decides: the ends of white space beyond ASCII
        self.tail = np.isin(np.arange(256), [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F])
        self.stem = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81])
        self.length = np.array([*map(len, tokens), 0], np.int64)  # the last one stands for unknown ids
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Ids of known fragments: number of a fragment, and where its ids stand in the pool."""
        self.known: dict[bytes, int] = {}
        self.pool, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def load(path: str) -> "ForcedBpe":
        return once(("bpe", path), lambda: ForcedBpe(path))

    def fragments(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Starts of all fragments of the joined texts; `starts` are those of the texts that are not empty."""
        if not len(data):
            return np.zeros(0, np.int64)
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        cut = self.cut[pair]
        odd = self.tail[data[1:-1]] & self.stem[data[:-2]]
        cut[1:] &= ~odd
        mark = np.zeros(len(data), bool)
        mark[1:] = cut
        mark[starts] = True
        return np.flatnonzero(mark)

    def encode(self, items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array (uint32), and how many each text has."""
        joined = b"".join(items)
        sizes = np.array([len(x) for x in items], np.int64)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(sizes)
        full = sizes > 0
        at = self.fragments(data, (ends - sizes)[full])
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(items), np.int64)
        offsets = np.append(at, len(data)).astype(np.int64)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        which = parts.indices.to_numpy(zero_copy_only=False)
        _, places, held = parts.dictionary.buffers()
        cut, held = np.frombuffer(places, np.int64)[: len(parts.dictionary) + 1].tolist(), held.to_pybytes()
        words = [held[a:b] for a, b in zip(cut, cut[1:])]
        at_pool = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at_pool < 0)
        if len(new):
            if len(self.known) + len(new) > FRAGMENTS_KEPT:
                self.forget()
                new = np.arange(len(words))
            fresh = [words[k] for k in new.tolist()]
            at_pool[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(fresh, at_pool[new].tolist()))
            ids, n = self.encode_fragments(fresh)
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(n) - n])
            self.count, self.pool = np.concatenate([self.count, n]), np.concatenate([self.pool, ids])
        count = self.count[at_pool][which]
        out = self.pool[ragged(self.first[at_pool][which], count)]
        upto = np.concatenate([[0], np.cumsum(count)])  # every text that is not empty starts a fragment
        return out, upto[np.searchsorted(at, ends)] - upto[np.searchsorted(at, ends - sizes)]

    def encode_fragments(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments in one array, and how many each has; each is encoded on its own."""
        ids = [e.ids for e in self.library.encode_batch_fast([x.decode() for x in parts], add_special_tokens=False)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text's ids, joined, with sequences that are not UTF-8 replaced as the library does.

        Ids that the vocabulary does not have say nothing, as in the library.
        """
        ids = np.where(ids < len(self.length) - 1, ids, len(self.length) - 1)
        length = self.length[ids]
        data = self.bytes[ragged(self.start[ids], length)].tobytes()
        upto = np.concatenate([[0], np.cumsum(length)])
        ends = np.cumsum(counts)
        cuts = list(zip(upto[ends - counts].tolist(), upto[ends].tolist()))
        out = [data[a:b] for a, b in cuts]
        try:
            data.decode()
            if not any(0x80 <= data[a] < 0xC0 for a, b in cuts if a < b):  # no text starts inside a character
                return out
        except UnicodeDecodeError:
            pass
        return [x.decode("utf-8", "replace").encode() for x in out]


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(first - (ends - count), count)


IDS = "n_tokens long, ids binary"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def coder(path: str, digest: bool):
    """The last column is the text; the others are kept."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBpe.load(path)
        for whole in batches:
            for batch in pieces(whole, whole.num_columns - 1):
                ids, counts = bpe.encode(texts(batch.column(batch.num_columns - 1)))
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                own = [raw[4 * a : 4 * b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                if digest:
                    back = bpe.decode(ids, counts)
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in of], pa.string()) for of in (own, back)]
                else:
                    more = [pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), *more], [*batch.schema.names[:-1], "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids"])])

    return code


def encode(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """`keep` columns, n_tokens, ids (little-endian unsigned 32-bit integers in one binary) of each row's whole text.

    As the tokenizers library encodes with add_special_tokens=False, unpadded and untruncated. Null text is empty and
    has no ids; rows are taken one by one, so ties and repeated rows change nothing; kept columns named as an output are
    replaced, other columns are not read. No shuffle.
    """
    keep = kept(keep, IDS)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(coder(path, False), shaped(docs, keep, IDS))


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The rows with a column `text`: each row's ids decoded on their own, special tokens kept; null ids give null.

    Bytes that are no UTF-8 become U+FFFD, also where a row's ids end inside a character; unknown ids say nothing.
    """

    @F.pandas_udf("string")
    def back(ids):
        import pandas as pd

        bpe, arrays = ForcedBpe.load(path), [np.frombuffer(x or b"", "<u4") for x in ids]
        out = bpe.decode(np.concatenate([np.zeros(0, np.uint32), *arrays]).astype(np.int64), np.array([len(x) for x in arrays], np.int64))
        return pd.Series([None if x is None else y.decode() for x, y in zip(ids, out)], dtype=object)

    return encoded.withColumn("text", back(column))


def digests(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass over the texts."""
    keep = kept(keep, DIGESTS)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(coder(path, True), shaped(docs, keep, DIGESTS))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"))

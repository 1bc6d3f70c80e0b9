"""What several operators of this subpackage share: the shared folder, written tables, links to components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.sources.store import drop, new_path, shared_dir, ship, written

__all__ = ["LOWER", "WHITE", "components", "drop", "kept", "mix", "new_path", "once", "pieces", "quoted", "row_of", "shaped", "shared_dir", "ship", "table", "texts", "written"]

WHITE = b" \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z only
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """A top-level column by its literal name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame):
    """All columns as one struct, so that columns of any name pass through an operator without a clash."""
    return F.struct(*(quoted(c) for c in df.columns))


def kept(keep: list[str], outputs: str) -> list[str]:
    """Columns to keep, without those that an output replaces (names are compared as Spark does, without case)."""
    made = {f.name.lower() for f in T.StructType.fromDDL(outputs)}
    return [c for c in keep if c.lower() not in made]


def shaped(df: DataFrame, keep: list[str], outputs: str) -> T.StructType:
    """Schema of the kept columns followed by the outputs."""
    return T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(outputs)])


def pieces(batch: pa.RecordBatch, column: str | int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about `most` bytes of text each (a longer text is a run of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    run = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(sizes)]):
        yield batch.slice(int(a), int(b - a))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_slot: dict[object, object] = {}


def once(key: object, build):
    """What build() makes, kept by the Python worker until another key is asked for: one large table at a time."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = build()
    return _slot[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that stands in a link: the smallest id that links (a, b) reach.

    Repeated neighbour minimum with pointer jumping; each round is written to the shared folder. Sums and minima are
    taken before the shuffle, so a node with very many links costs a row for each task, not for each link.
    Null ends are ignored; links to itself and repeated links change nothing.
    """
    a, b = F.col("a"), F.col("b")
    clean = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select("a", "b")
    edges = written(clean.union(clean.select(b, a)).toDF("a", "b").distinct(), "edges")
    label = old = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "label")
    while True:  # the labels get smaller in each round, or it is the last
        near = edges.join(label.toDF("b", "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = label.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", "component", F.least("component", "c").alias("c"))
        jump = label.toDF("c", "cc")
        new = step.join(jump, "c", "left").select("id", F.coalesce(F.least("c", "cc"), "c").alias("component"), (F.coalesce(F.least("c", "cc"), "c") != F.col("component")).alias("moved"))
        new = written(new, "label")
        done = new.where("moved").isEmpty()
        drop(old)
        label, old = new.drop("moved"), new
        if done:
            drop(edges)
            return label

"""Shared pieces: written stages, Arrow text primitives and hashing used by several operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of about this many bytes is worked on at once, so a worker's memory depends on it and on the longest document.
SLICE_BYTES = 2 << 20

#: Paths and catalog tables of stages, by session; they go with released() or at exit.
_written: list[tuple[SparkSession, str, str | None]] = []
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary folder if it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return _own_dir[0]


def new_path(spark: SparkSession, label: str, table: bool = False) -> str:
    """A path below the shared folder that is dropped later, with the catalog table of table_name(), if there is one."""
    path = f"{shared_dir(spark).rstrip('/')}/plumbline/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path, table_name(path) if table else None))
    return path


def table_name(path: str) -> str:
    return "plumbline_" + path.rpartition("/")[2].replace("-", "_")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps neither repeat it nor lose it with an executor."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def released() -> Iterator[None]:
    """What operators stage inside the block goes at its end: results must be written or collected before."""
    before = len(_written)
    try:
        yield
    finally:
        _drop_from(before)


def drop_stages() -> None:
    """Drop all that operators have staged so far: no result that still reads it may be in use."""
    _drop_from(0)


def _drop_from(first: int) -> None:
    for spark, path, table in _written[first:]:
        if table:
            spark.sql(f"drop table if exists {table}")
        drop_path(spark, path)
    del _written[first:]


@atexit.register
def _clean() -> None:
    try:
        _drop_from(0)
    except Exception:  # the session may be gone
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def plain(df: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, so further columns with clashing names cannot disturb an operator."""
    return df.select(*[F.col(c) for c in needed])


#: Keys that are joined by broadcast, at most: each holds this share of all rows or more.
HOT_KEYS = 4096


def join_shared(rows: DataFrame, shared: DataFrame, keys: list[str], members: str, n_rows: int) -> DataFrame:
    """``rows`` with what ``shared`` (fixed-width columns, one row for each key) says of their keys; rows of other keys go.

    ``members`` is a column of ``shared``: as many of the ``n_rows`` rows as have the key, or fewer.  Keys with a share of
    1 / HOT_KEYS or more, which cannot be more than HOT_KEYS, are broadcast: their rows stay where they are, so a key with a third of all
    rows fills no task.  The rows of all other keys are shuffled.
    """
    least = max(2, -(-n_rows // HOT_KEYS))
    hot = shared.where(F.col(members) >= least)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(shared.where(F.col(members) < least), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def hot_keys(rows: DataFrame, keys: list[str], total: int | None = None, members: str | None = None) -> list[tuple[int, int]]:
    """Keys of ``rows`` with a share of 1 / partitions of all rows or more, which cannot be more than there are partitions: the hash of each and the number of tasks it fills.

    ``members`` is a column with the number of rows of a key, if ``rows`` are counted already; ``total`` is the number of all rows, if known.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = (rows.agg(F.sum(members)).first()[0] or 0) if members else rows.count()
    counts = rows.select(*keys, F.col(members).alias("_c")) if members else rows.groupBy(*keys).agg(F.count("*").alias("_c"))
    return [tuple(r) for r in counts.where(F.col("_c") * parts > total).select(F.xxhash64(*keys), F.ceil(F.col("_c") * F.lit(parts / max(1, total))).cast("int")).collect()] if total else []


def _tasks(keys: list[str], hot: list[tuple[int, int]]) -> Column:
    """The number of tasks of a key, in powers of two: sets of hashes in the plan, no join.  Whatever shares a hash with a hot key is spread too."""
    levels: dict[int, list[int]] = {}
    for h, n in hot:
        levels.setdefault(1 << (n - 1).bit_length(), []).append(h)
    out = F.lit(1)
    for n, hashes in sorted(levels.items()):
        out = F.when(F.xxhash64(*keys).isin(hashes), n).otherwise(out)
    return out


def join_spread(rows: DataFrame, other: DataFrame, keys: list[str], by: str, how: str = "inner", hot: list[tuple[int, int]] | None = None) -> DataFrame:
    """``rows`` (inner, left or left_semi) joined with ``other`` by ``keys`` of the same types; a key with more rows than a partition's share is spread over as many tasks as it fills.

    ``by`` is a column of ``rows`` that tells the rows of one key apart.  ``hot`` are the keys to spread, by hot_keys(); without it they are
    looked for, and ``rows`` are read twice.  Rows of ``other`` with such a key are repeated for each task of it.
    """
    if hot is None:
        hot = hot_keys(rows, keys)
    tasks = _tasks(keys, hot)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), tasks).cast("int"))
    other = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), tasks - 1)) if hot else F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int"))
    return rows.join(other, [*keys, "_salt"], how).drop("_salt")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; one longer text makes a part of its own."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < n:
        to = int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right"))
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(pa.concat_arrays([batch.column(column)]), "")


def split_words(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one array, and where each text's words begin (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(arr)
    flat, offs = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    offs = offs - offs[0]
    some = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not some.all():
        flat = flat.filter(pa.array(some))
        offs = np.concatenate([[0], np.cumsum(some)])[offs]
    return flat, offs


def split_lines(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(arr, "\n")
    offs = np.asarray(lists.offsets).astype(np.int64)
    return lists.flatten(), offs - offs[0]


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of equal strings, and the string of each code."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def owner(offs: np.ndarray) -> np.ndarray:
    """For each element, the number of the list that holds it."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def segment_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offs])


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    total = int(lens.sum())
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return shift + np.arange(total)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def hash_strings(arr: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings (SipHash with a fixed key): equal on every machine."""
    import pandas as pd

    return pd.util.hash_array(arr.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(arr) else np.empty(0, np.uint64)

"""Helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.session import cut_lineage

#: rows and bytes of text that one Arrow batch from a Python task holds at most (one row at least)
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by five; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which executors and driver share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", ""):
        cut_lineage(spark.range(1))  # lets the session helper choose a folder, as in tests
    return f"{spark.conf.get('spark.checkpoint.dir', '') or sc.getCheckpointDir()}/quantspark-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: what follows starts from a table."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, so that one batch of results stays small."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(col).to_pylist()], dtype=np.int64)
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > BATCH_BYTES or i - start >= BATCH_ROWS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if len(sizes) > start:
            yield batch.slice(start)


def give_back() -> None:
    """Memory that this worker has freed goes back to the machine; Arrow and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU only
    if trim is not None:
        trim(0)


#: what a worker keeps from one task of an operator to the next, by operator: how to drop it
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """Says, in a worker, that ``operator`` keeps something there which ``drop`` drops."""
    _kept[operator] = drop


def drop_others(operator: str) -> None:
    for name in [n for n in _kept if n != operator]:
        _kept.pop(name)()


def released(run: Callable[[Iterator], Iterator], operator: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, in a worker that Spark keeps for later stages.

    What other operators than ``operator`` have left in the worker is dropped first; afterwards, freed
    memory goes back.
    """

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        drop_others(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def lists(values: np.ndarray | pa.Array, lengths: list[int]) -> pa.Array:
    """One list per row out of the rows' values end to end."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


#: the columns of documents that stage functions use by name
USED = ("doc_id", "text", "source", "n_chars")


def own_columns(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of documents that gives their columns back, safe from the names of further ones.

    Inside, columns that it does not use stand under names that none of its own can have.
    """

    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        inner = docs.toDF(*[c if c in USED else f"own_column_{i}_" for i, c in enumerate(docs.columns)])
        return stage(inner, *args, **kwargs).toDF(*docs.columns)

    return run

"""Plumbing shared by the training-data operators: scratch tables, ids, text bytes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The session's ``spark.checkpoint.dir`` names it.  Only where that is unset and all of Spark
    is in one process is a temporary folder of this machine used instead; a cluster without a
    shared folder is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = context._lexsift_dir = getattr(context, "_lexsift_dir", None) or tempfile.mkdtemp(prefix="lexsift-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named


_SCOPES: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """Paths of the tables that are written down meanwhile, so that they can be removed after use."""
    _SCOPES.append(made := [])
    try:
        yield made
    finally:
        _SCOPES.pop()


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables that ``materialise`` wrote; frames that read them can't be used any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors, and pins down anything that
    depends on how rows were dealt over tasks.  The table stays, as results are read from it
    lazily, until the path, which a ``scope`` tells, is given to ``remove``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexsift-{name}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables in loops.

    Spark deletes it once nothing refers to it if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is on; else it stays until the shared folder is cleared.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def as_bytes(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    for value in texts.cast(pa.binary()):
        yield value.as_py() or b""


def ascii_words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, then split at the six ASCII white-space bytes (bytes.split's own set)."""
    return raw.lower().split()


def batches(rows: Iterable[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def give_back() -> None:
    """Memory that is free, but that Arrow or C holds for later, goes back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only some systems have it
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict = {}


def kept(key, make):
    """What a worker keeps between tasks, such as remembered words; the last key only.

    Workers outlive a query, so the memory of one operator must not stay while the next one works.
    """
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]

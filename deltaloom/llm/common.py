"""Shared helpers: the shared folder, materialised tables, connected components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.sources.components import connected_components, star_labels  # noqa: F401
from deltaloom.sources.shared import folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back."""
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is: the module public_tokenizers says so, else the folder it comes in."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def file_system(uri: str):
    """(pyarrow filesystem, path in it) of a shared-folder URI, for file formats that Spark doesn't write."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else ("file://" + os.path.abspath(uri.removeprefix("file:"))))


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A worker's cache of one operator; those of others are dropped, as stages share their workers' memory."""
    for other, cache in _caches.items():
        if other != name:
            cache.clear()
    return _caches.setdefault(name, {})


def trim() -> None:
    """Gives freed memory back to the system, where the C library can: a worker shares its executor's bound with others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def share_of(column):
    """A number in [0, 1) from the hash of a value: rows below a share of it are a sample, drawn where they stand. (An order with a
    limit would send the limit's rows of every partition to one task.)"""
    return F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(1 << 53))


def lower_ascii(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def crc_mod(column, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n

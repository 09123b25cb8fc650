"""Sources: blobs (blob_id, content) from files, text columns or tables."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.functions import codecs
from deltaloom.sources.shared import written

_ROW_BITS = 33  # of the ids that Spark gives: partition, then row within it


def numbered(rows: DataFrame, order: str, name: str = "blob_id") -> DataFrame:
    """Adds dense numbers in the order of a column of distinct values: sorted and written once, then each partition's rows are
    counted on from those of the partitions before (a row for each partition)."""
    table = written(rows.orderBy(order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", _ROW_BITS)
    sizes = table.groupBy(part.alias("p")).count().orderBy("p").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["p"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_p long, _start long")
    found = table.withColumn("_p", part).join(F.broadcast(starts), "_p")
    return found.withColumn(name, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_p", "_m", "_start")


def files(spark: SparkSession, path: str) -> DataFrame:
    """blob_id, path, length of the files, numbered in the order of their paths; contents are not read."""
    return numbered(spark.read.format("binaryFile").load(path).select("path", "length"), "path").select("blob_id", "path", "length")


def from_files(spark: SparkSession, path: str, unpack: bool = False) -> DataFrame:
    """blob_id, path, content, packed_as of whole files of less than 2 GB; with unpack, gzip, bzip2, xz and compress are undone by
    their first bytes, and packed_as says which it was (null: none)."""
    found = spark.read.format("binaryFile").load(path).select("path", "content").join(files(spark, path).select("blob_id", "path"), "path")

    @F.pandas_udf("struct<content: binary, packed_as: string>")
    def plain(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"content": [codecs.unpack_outer(d) for d in s], "packed_as": [codecs.outer_kind(d) for d in s]})

    if not unpack:
        return found.select("blob_id", "path", "content", F.lit(None).cast("string").alias("packed_as"))
    return found.select("blob_id", "path", plain("content").alias("p")).select("blob_id", "path", "p.*")


def from_ranges(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """blob_id, path, range_idx, content: files of any size in pieces, read by their tasks. Each piece is cut by itself, so a file
    of one piece has the chunks that from_files() gives. Numbers of blobs go on over the pieces of a file.

    Pieces are read by Arrow's file systems, so the path is a local one or of a store that these know.
    """
    listed = files(spark, path)
    count = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1)).cast("long")
    pieces = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("range_idx"))
    pieces = numbered(pieces.withColumn("_key", F.concat_ws("/", "path", F.lpad(F.col("range_idx").cast("string"), 12, "0"))), "_key").drop("_key")
    pieces = pieces.select("blob_id", "path", "range_idx", "length")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                where, k = row.column(1)[0].as_py(), row.column(2)[0].as_py()
                store, name = fs.FileSystem.from_uri(where.replace("file:/", "file:///", 1) if where.startswith("file:/") and not where.startswith("file://") else where)
                with store.open_input_file(name) as source:
                    source.seek(k * range_bytes)
                    data = source.read(min(range_bytes, max(0, row.column(3)[0].as_py() - k * range_bytes)))
                yield pa.RecordBatch.from_arrays([*row.columns[:3], pa.array([data], pa.binary())], names=["blob_id", "path", "range_idx", "content"])

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartition(spread, "blob_id").mapInArrow(run, "blob_id long, path string, range_idx long, content binary")


def from_text(table: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """UTF-8 bytes of a text column; null texts are empty."""
    return table.select(F.col(id_col).alias("blob_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))

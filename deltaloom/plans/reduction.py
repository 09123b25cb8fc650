"""The whole reduction: blobs -> chunks -> dedup -> sketches -> index -> encoding -> report; store and restore."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.config import EngineConfig
from deltaloom.functions import codecs
from deltaloom.operators import reduce as ops
from deltaloom.sources.shared import written


@dataclass
class Reduction:
    deduped: DataFrame
    sketched: DataFrame
    candidates: DataFrame
    encoded: DataFrame
    config: EngineConfig

    def report(self) -> DataFrame:
        return ops.report(self.deduped, self.encoded)


def reduce(blobs: DataFrame, config: EngineConfig) -> Reduction:
    """Chunks with their digests and sketches are written once, as each is read several times.

    Blobs may have the columns of the scope: duplicates and bases are looked for among rows that agree in them.
    """
    chunks = ops.fixed_chunks(blobs, config.normal_size) if config.chunker == "fixed" else ops.content_chunks(blobs, config)
    chunks = written(chunks.drop("bits").withColumn("fp", F.sha2("data", 256)), "chunks")
    chunks = ops.limited(chunks, config.limit_fraction)
    scope = config.scope
    deduped = ops.dedup(chunks, config, F.col("fp"))
    sketched = ops.sketches(deduped.where("not is_dup"), config).select(*dict.fromkeys(["blob_id", *scope]), "ord", "size", "data", "bits", "features", "sfp")
    sketched = written(sketched, "sketched")
    candidates = ops.cluster_base_parts(sketched, scope) if config.index == "cluster" else ops.latest_base(ops.index_keys(sketched, scope), scope)
    return Reduction(deduped, sketched, candidates, ops.encode(sketched, candidates, config), config)


def store(reduction: Reduction, path: str) -> None:
    """Writes a chunk store and the recipes of the blobs as tables, and the options that reading needs."""
    c = reduction.config
    reduction.encoded.select("ord", "base_ord", "size", "kind", "stored").write.parquet(f"{path}/chunks")
    reduction.deduped.select("blob_id", "idx", "first_ord", "size").write.parquet(f"{path}/recipes")
    spark = reduction.encoded.sparkSession
    spark.createDataFrame([(c.delta, c.lossless, c.delta_post_compress)], "delta string, lossless string, delta_post_compress boolean").write.parquet(f"{path}/header")


def restore(spark, path: str, config: EngineConfig) -> DataFrame:
    """blob_id, content from a store. Delta chains are undone level by level: each round decodes chunks whose base is known.

    Chains may be of any depth; a chunk whose base is never decoded is an error, and so is a recipe whose chunk is missing or
    a store that was written with other codecs. Rounds are written tables; a blob's parts are put together in order.
    """
    written_with = spark.read.parquet(f"{path}/header").first()
    if (written_with["delta"], written_with["lossless"], written_with["delta_post_compress"]) != (config.delta, config.lossless, config.delta_post_compress):
        raise ValueError(f"the store was written with {written_with.asDict()}")
    left = spark.read.parquet(f"{path}/chunks")

    @F.pandas_udf("binary")
    def plain(kind: pd.Series, stored: pd.Series, size: pd.Series, base: pd.Series) -> pd.Series:
        out = []
        for k, s, n, b in zip(kind, stored, size, base):
            if k == "raw":
                out.append(s)
            elif k == "lossless":
                out.append(codecs.decompress(s, int(n), config.lossless))
            else:
                s = codecs.decompress(s, 1 << 26, "zstd") if config.delta_post_compress else s
                out.append(codecs.DECODERS[config.delta](s, b))
        return pd.Series(out, dtype=object)

    none = F.lit(None).cast("binary")
    fresh = written(left.where("kind <> 'delta'").select("ord", plain("kind", "stored", "size", none).alias("data")), "decoded")
    left = left.where("kind = 'delta'")
    levels, open_chunks = [fresh], left.count()
    while open_chunks:
        base = fresh.select(F.col("ord").alias("base_ord"), F.col("data").alias("base"))
        fresh = written(left.join(base, "base_ord").select("ord", plain("kind", "stored", "size", "base").alias("data")), "decoded")
        decoded = fresh.count()
        if not decoded:
            raise ValueError(f"{open_chunks} chunks of the store have no decoded base")
        open_chunks -= decoded
        levels.append(fresh)
        if len(levels) == 50:
            levels = [written(_union(levels), "decoded")]
    done = _union(levels).withColumnRenamed("ord", "first_ord")
    recipes = spark.read.parquet(f"{path}/recipes").join(done, "first_ord", "left")
    data = F.when(F.col("data").isNull(), F.raise_error(F.lit("a recipe names a chunk that the store has not")).cast("binary")).otherwise(F.col("data"))
    parts = recipes.select("blob_id", "idx", data.alias("data")).groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("parts"))

    @F.pandas_udf("binary")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda own: b"".join(own))

    return parts.select("blob_id", joined(F.transform("parts", lambda p: p["data"])).alias("content"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def write_events(events: DataFrame, path: str) -> None:
    """The measurements as CSV with a header: method, block_reduction_ratio, time(us)."""
    events.select("method", "block_reduction_ratio", F.col("micros").alias("time(us)")).write.option("header", True).csv(path)


def grid(blobs: DataFrame, configs: dict[str, EngineConfig], dataset_col: str | None = None) -> DataFrame:
    """Reports of many configurations, and with a dataset column of each dataset by itself: a row each."""
    out = None
    names = [None] if dataset_col is None else [r[0] for r in blobs.select(dataset_col).distinct().orderBy(dataset_col).collect()]  # runs, not rows
    for name, config in configs.items():
        for dataset in names:
            own = blobs if dataset_col is None else blobs.where(F.col(dataset_col).eqNullSafe(F.lit(dataset)))
            row = reduce(own, config).report().withColumns({"config": F.lit(name), "dataset": F.lit(dataset).cast("string")})
            out = row if out is None else out.unionByName(row)
    return out

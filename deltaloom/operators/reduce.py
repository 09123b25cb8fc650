"""Chunking, exact dedup, sketches, the similarity index, encoding and reports, as DataFrame operators.

chunks: blob_id, idx, ord, offset, size, data[, bits], and the columns of the blobs that are kept. ord = blob_id * 2^20 + idx is
the stream order; blobs beyond what it can number are an error.
"""

from __future__ import annotations

import time

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deltaloom.config import EngineConfig
from deltaloom.functions import bytescan, codecs
from deltaloom.sources.components import connected_components
from deltaloom.sources.shared import written

IDX_BITS = 20
MOST_BLOBS = 1 << 63 - IDX_BITS
#: Rows of a key that one task orders, about; a key with more is cut into ranges of the stream.
RANGE_ROWS = 1_000_000
#: Bytes of chunks that a batch between Python and the JVM holds, about.
BATCH_BYTES = 8 << 20


def content_chunks(blobs: DataFrame, config: EngineConfig) -> DataFrame:
    """Cuts each blob (blob_id, content, columns to keep) at content-defined places; null and empty blobs give no chunk."""
    kept = [c for c in blobs.columns if c not in ("blob_id", "content")]
    names = ["blob_id", "idx", "ord", "offset", "size", "data", "bits"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())

    def run(batches):
        for batch in batches:
            start = 0
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            while start < batch.num_rows:
                stop, held = start, 0
                while stop < batch.num_rows and (stop == start or held + sizes[stop] <= BATCH_BYTES):
                    held += sizes[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                datas = [d or b"" for d in part.column(1).to_pylist()]
                rows, owners = [], []
                for k, (blob, data, found) in enumerate(zip(part.column(0).to_pylist(), datas, bytescan.chunks_of(datas, config))):
                    if found and (blob is None or not 0 <= blob < MOST_BLOBS or len(found) > 1 << IDX_BITS):
                        raise ValueError(f"blob {blob} of {len(found)} chunks is beyond the stream order")
                    rows += [(blob, i, (blob << IDX_BITS) + i, at, n, data[at : at + n], None if b is None else bytescan.signed(b)) for i, (at, n, b) in enumerate(found)]
                    owners += [k] * len(found)
                if rows:
                    own = part.take(pa.array(owners))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + [own.column(i) for i in range(2, own.num_columns)], names=names + kept)
                start = stop

    schema = "blob_id long, idx int, ord long, offset long, size int, data binary, bits long" + "".join(f", `{c}` {blobs.schema[c].dataType.simpleString()}" for c in kept)
    return blobs.select("blob_id", "content", *kept).mapInArrow(run, schema)


def fixed_chunks(blobs: DataFrame, size: int = 8192, keep_tail: bool = True) -> DataFrame:
    """Blocks of a fixed size, by built-in functions; the shorter last block is kept or dropped. Other columns are kept."""
    kept = [F.col(c) for c in blobs.columns if c not in ("blob_id", "content")]
    n = F.octet_length("content")
    count = (F.ceil(n / size) if keep_tail else F.floor(n / size)).cast("int")
    idx = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)))
    rows = blobs.select("blob_id", "content", *kept, idx.alias("idx"))
    data = F.substring(F.col("content"), F.col("idx") * size + 1, F.lit(size))
    numbered = (F.col("blob_id") >= 0) & (F.col("blob_id") < MOST_BLOBS) & (F.col("idx") < 1 << IDX_BITS)
    order = F.when(numbered, F.col("blob_id") * (1 << IDX_BITS) + F.col("idx")).otherwise(F.raise_error(F.lit("a blob is beyond the stream order")).cast("long"))
    return rows.select(
        "blob_id", "idx", order.alias("ord"), (F.col("idx") * size).cast("long").alias("offset"), F.octet_length(data).alias("size"), data.alias("data"), *kept
    )


def kth(values: DataFrame, k: int, width: int = 1024) -> int | None:
    """The k-th smallest (from 0) of a column of distinct longs, by counting in ever narrower ranges; None if there are not so many."""
    name = values.columns[0]
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if k >= n:
        return None
    while high > low:
        step = -(-(high - low + 1) // width)
        place = F.floor((F.col(name) - F.lit(low)) / F.lit(step))
        found = values.where(F.col(name).between(low, high)).groupBy(place.alias("r")).count().orderBy("r").collect()  # at most width rows
        for r in found:
            if k < r["count"]:
                low, high = low + r["r"] * step, min(high, low + (r["r"] + 1) * step - 1)
                break
            k -= r["count"]
    return low


def limited(chunks: DataFrame, fraction: float) -> DataFrame:
    """The first part of the stream: so large a fraction of the chunks, rounded down."""
    if fraction >= 1:
        return chunks
    first_out = kth(chunks.select("ord"), int(chunks.count() * fraction))
    return chunks if first_out is None else chunks.where(F.col("ord") < first_out)


def _on(by: list[str], left: str, right: str) -> list[Column]:
    """Equality of the columns of two aliased sides; nulls are equal, so that rows with a null scope are not lost."""
    return [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by]


def dedup(chunks: DataFrame, config: EngineConfig, key: Column | None = None) -> DataFrame:
    """Adds fp, first_ord and is_dup: the first occurrence in stream order stays. SHA-256 unless another key is given.

    Decided on (fp, ord) alone: first occurrences come from a partial aggregate and are written, so that the join of a chunk
    that is repeated billions of times is one of two plain exchanges, which adaptive execution can split. Bytes join by
    the unique ord.
    """
    keyed = chunks.withColumn("fp", key if key is not None else F.sha2("data", 256))
    by = [*config.scope, "fp"]
    first = written(keyed.groupBy(*by).agg(F.min("ord").alias("first_ord")), "first")
    found = keyed.select("ord", *by).alias("k").join(first.alias("f"), _on(by, "k", "f")).select(F.col("k.ord").alias("ord"), "first_ord")
    return keyed.join(found, "ord").withColumn("is_dup", F.col("first_ord") < F.col("ord"))


def bitmap_column(data: Column | str = "data") -> Column:
    @F.pandas_udf("long")
    def sketch(s: pd.Series) -> pd.Series:
        found = iter(bytescan.bitmap_sketches([d for d in s if d is not None]).astype("int64").tolist())
        return pd.Series([None if d is None else next(found) for d in s], dtype="Int64")

    return sketch(data)


def features_column(kind: str, n: int, data: Column | str = "data") -> Column:
    @F.pandas_udf("array<long>")
    def found(s: pd.Series) -> pd.Series:
        f = {"odess": bytescan.odess_features, "ntransform": bytescan.ntransform_features, "finesse": bytescan.finesse_features}[kind]
        return s.map(lambda d: None if d is None else f(d, n))

    return found(data)


def bitmap_super_features(bits: Column, n: int) -> Column:
    """n overlapping 32-bit windows of the bitmap."""
    step = 32 // (n - 1) if n > 1 else 0
    return F.array(*[F.shiftrightunsigned(bits, i * step).bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(n)])


def grouped_super_features(features: Column, n_features: int, n: int) -> Column:
    """Hashes of n strided groups of the features; null where all features are zero (nothing was sampled)."""
    if n_features % n:
        raise ValueError("super-features must divide features")
    groups = F.array(*[F.xxhash64(*[features[j] for j in range(i, n_features, n)]) for i in range(n)])
    return F.when(F.exists(features, lambda x: x != 0), groups)


def sketches(unique: DataFrame, config: EngineConfig) -> DataFrame:
    """Adds bits (bitmap sketches only), features (others only) and sfp, the keys of the similarity index."""
    if config.sketch == "bitmap":
        rows = unique.withColumn("bits", bitmap_column()).withColumn("features", F.lit(None).cast("array<long>"))
        return rows.withColumn("sfp", F.when(F.col("bits") != 0, bitmap_super_features(F.col("bits"), config.super_features)))
    rows = unique.withColumn("bits", F.lit(None).cast("long")).withColumn("features", features_column(config.sketch, config.features))
    return rows.withColumn("sfp", grouped_super_features(F.col("features"), config.features, config.super_features))


def index_keys(sketched: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    return sketched.where("sfp is not null").select(*scope, "ord", F.posexplode("sfp").alias("sf_pos", "sf_value"))


def _with_previous(keys: DataFrame, scope: tuple[str, ...] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds base, the latest earlier ord under the same key (null for the first).

    The stream is cut into ranges by ord. A window orders the rows of a key in one range; the first of them gets the last of
    the key's range before, from a table with a row for each key and range. So a key that most rows share is many windows.
    """
    by = [*scope, "sf_pos", "sf_value"]
    low, high, n = keys.agg(F.min("ord"), F.max("ord"), F.count("*")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // range_rows))))
    ranged = keys.select(*by, "ord", F.floor((F.col("ord") - F.lit(low or 0)) / F.lit(width)).alias("range"))
    inside = ranged.withColumn("base", F.lag("ord").over(Window.partitionBy(*by, "range").orderBy("ord")))
    if n <= range_rows:
        return inside.drop("range")
    ends = ranged.groupBy(*by, "range").agg(F.min("ord").alias("ord"), F.max("ord").alias("last"))
    carried = ends.select(*by, "ord", F.lag("last").over(Window.partitionBy(*by).orderBy("range")).alias("base"))
    return inside.where("base is not null").drop("range").unionByName(carried)


def latest_base(keys: DataFrame, scope: tuple[str, ...] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """ord, base_ord, sf_pos: the latest earlier chunk that shares a key, at the lowest position that has one."""
    found = _with_previous(keys, scope, range_rows).where("base is not null")
    best = found.groupBy("ord").agg(F.min(F.struct("sf_pos", "base")).alias("b"))
    return best.select("ord", F.col("b.base").alias("base_ord"), F.col("b.sf_pos").alias("sf_pos"))


def cluster_base(sketched: DataFrame, scope: tuple[str, ...] = ("blob_id",)) -> DataFrame:
    """The order-dependent variant: a hit makes the chunk the newest of its cluster, under all keys of the cluster.

    Serial by nature, so it runs scope by scope over skinny rows (ord, sfp).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tables: list[dict[int, list[int]]] = []
        out = []
        for o, keys in rows.sort_values("ord")[["ord", "sfp"]].itertuples(index=False):
            tables += [{} for _ in range(len(keys) - len(tables))]
            pos, node = next(((i, tables[i][k]) for i, k in enumerate(keys) if k in tables[i]), (None, None))
            if node is not None:
                out.append((o, node[0], pos))
                node[0] = o
            else:
                node = [o]
            for i, k in enumerate(keys):
                tables[i][k] = node
        return pd.DataFrame(out, columns=["ord", "base_ord", "sf_pos"])

    rows = sketched.where("sfp is not null").select(*scope, "ord", "sfp")
    return rows.groupBy(*scope).applyInPandas(run, "ord long, base_ord long, sf_pos int")


def cluster_base_parts(sketched: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """cluster_base() over the whole scope: chunks without a common key, directly or by others, never meet in it.

    So each connected component of shared keys is a stream of its own, serial by itself, and components run side by
    side. A corpus whose chunks all hang together is one component, in one task.
    """
    spark = sketched.sparkSession
    rows = sketched.where("sfp is not null").select(*scope, "ord", "sfp")
    keys = rows.select(*scope, "ord", F.posexplode("sfp").alias("sf_pos", "sf_value"))
    least = keys.groupBy(*scope, "sf_pos", "sf_value").agg(F.min("ord").alias("v"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"l.{c}")) for c in (*scope, "sf_pos", "sf_value")]
    edges = keys.alias("k").join(least.alias("l"), same).select(F.col("k.ord").alias("u"), F.col("l.v").alias("v"))
    roots = connected_components(spark, edges).select(F.col("node").alias("ord"), F.col("root").alias("part"))
    return cluster_base(rows.join(roots, "ord").select("part", "ord", "sfp"), ("part",))


def index_size(keys: DataFrame) -> DataFrame:
    return keys.groupBy("sf_pos").agg(F.countDistinct("sf_value").alias("n_keys"))


def index_memory(unique_chunks: Column, keys: Column, n: int, bitmap: bool = True) -> Column:
    """Bytes that an index in memory would take: 12 for each unique chunk and, by bitmaps, 8 for each super-feature of each key;
    by feature vectors the node and its n super-features of 8 bytes, and 4 for each key."""
    node = 12 if bitmap else 24 + 8 * n
    return unique_chunks * node + keys * (8 * n if bitmap else 4)


def similar_pairs(keys: DataFrame, least_shared: int = 1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Neighbours in stream order under a key, with the number of keys they share."""
    found = _with_previous(keys, (), range_rows).where("base is not null").withColumnRenamed("base", "base_ord")
    return found.groupBy("ord", "base_ord").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= least_shared)


def base_bytes(unique: DataFrame, candidates: DataFrame) -> DataFrame:
    """ord, size, data, base_ord, base_size, base_data: each unique chunk with its base's bytes, null without a base."""
    base = unique.select(F.col("ord").alias("base_ord"), F.col("size").alias("base_size"), F.col("data").alias("base_data"))
    return unique.select("ord", "size", "data").join(candidates.select("ord", "base_ord"), "ord", "left").join(base, "base_ord", "left")


def anti_hamming(a: Column, b: Column) -> Column:
    return F.bit_count(F.bitwise_not(a.bitwiseXOR(b)))


def shared_ones(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseAND(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def choose(size: Column, self_size: Column, delta_size: Column) -> Column:
    """The cheapest form; a tie goes to lossless, then raw."""
    return F.when(delta_size.isNotNull() & (F.least(self_size, size) > delta_size), "delta").when(self_size < size, "lossless").otherwise("raw")


def _delta_udf(config: EngineConfig):
    @F.pandas_udf("binary")
    def encode(new: pd.Series, base: pd.Series, new_bits: pd.Series, base_bits: pd.Series) -> pd.Series:
        out = []
        for n, b, x, y in zip(new, base, new_bits, base_bits):
            if b is None:
                out.append(None)
                continue
            if config.delta == "gdelta_sketch":
                d = codecs.gdelta_sketch_encode(n, b, int(x) & bytescan.U64, int(y) & bytescan.U64)
            else:
                d = codecs.ENCODERS[config.delta](n, b)
            out.append(codecs.compress(d, "zstd", config.level) if config.delta_post_compress else d)
        return pd.Series(out, dtype=object)

    return encode


def _self_udf(config: EngineConfig):
    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda d: codecs.compress(d, config.lossless, config.level))

    return encode


def encode(sketched: DataFrame, candidates: DataFrame, config: EngineConfig) -> DataFrame:
    """ord, base_ord, size, self_size, delta_size, sim, kind, stored, stored_size of each unique chunk."""
    if config.delta == "gdelta_sketch" and config.sketch != "bitmap":
        raise ValueError("sketch-guided deltas need the bitmap sketch")
    base = sketched.select(F.col("ord").alias("base_ord"), F.col("data").alias("base_data"), F.col("bits").alias("base_bits"))
    rows = sketched.select("ord", "size", "data", "bits").join(candidates.select("ord", "base_ord"), "ord", "left").join(base, "base_ord", "left")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("packed", _self_udf(config)("data")).withColumn(
        "delta", _delta_udf(config)("data", "base_data", F.coalesce("bits", zero), F.coalesce("base_bits", zero))
    )
    rows = rows.withColumn("self_size", F.octet_length("packed")).withColumn("delta_size", F.octet_length("delta"))
    rows = rows.withColumn("kind", choose(F.col("size"), F.col("self_size"), F.col("delta_size")))
    stored = F.when(F.col("kind") == "delta", F.col("delta")).when(F.col("kind") == "lossless", F.col("packed")).otherwise(F.col("data"))
    return rows.select(
        "ord", "base_ord", "size", "self_size", "delta_size", anti_hamming(F.col("bits"), F.col("base_bits")).alias("sim"), "kind",
        stored.alias("stored"), F.octet_length(stored).alias("stored_size"),
    )


def report(deduped: DataFrame, encoded: DataFrame) -> DataFrame:
    """One row: counts and bytes by outcome, compress ratio, delta efficiency, dedup ratio."""
    totals = deduped.agg(
        F.count("*").alias("total_chunks"), F.sum(F.col("size").cast("long")).alias("total_bytes"), F.count_if("is_dup").alias("dup_chunks"),
        F.sum(F.when(F.col("is_dup"), F.col("size")).otherwise(0).cast("long")).alias("dup_bytes"), F.count_if(F.col("size") <= 4096).alias("small_chunks"),
    )
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).cast("long")
    kinds = encoded.agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_chunks") for k in ("delta", "lossless", "raw")],
        *[of(k, "size").alias(f"{k}_bytes") for k in ("delta", "lossless", "raw")],
        *[of(k, "stored_size").alias(f"{k}_stored") for k in ("delta", "lossless", "raw")],
        F.count("base_ord").alias("similar_found"),
    )
    # both have one row: columns of the one are null in the other's
    one = totals.unionByName(kinds, allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    stored = F.col("delta_stored") + F.col("lossless_stored") + F.col("raw_stored")
    reduced = F.col("delta_bytes") - F.col("delta_stored")
    return one.withColumns(
        {
            "compress_ratio": F.col("total_bytes") / F.nullif(stored, F.lit(0)),
            "dce": 100 * reduced / F.nullif(F.col("delta_stored"), F.lit(0)),
            "dedup_ratio": F.col("total_bytes") / F.nullif(F.col("total_bytes") - F.col("dup_bytes"), F.lit(0)),
            "final_percent": 100 * stored / F.nullif(F.col("total_bytes"), F.lit(0)),
        }
    )


def dce_by_similarity(encoded: DataFrame) -> DataFrame:
    rows = encoded.where("kind = 'delta'").groupBy("sim").agg(F.sum(F.col("size") - F.col("stored_size")).cast("long").alias("reduced"), F.sum("stored_size").cast("long").alias("stored"))
    return rows.withColumn("dce", 100 * F.col("reduced") / F.nullif("stored", F.lit(0)))


CODECS = ("gdelta", "edelta", "vcdiff", "zdelta")


def codec_sizes(sketched: DataFrame, candidates: DataFrame, config: EngineConfig) -> DataFrame:
    """ord, size, self_size and for each codec its delta's size and microseconds (null without a base): one join, one pass."""

    @F.pandas_udf("struct<packed: struct<size:int, micros:long>, " + ", ".join(f"{c}: struct<size:int, micros:long>" for c in CODECS) + ">")
    def sizes(new: pd.Series, base: pd.Series) -> pd.DataFrame:
        out = []
        for n, b in zip(new, base):
            row = {}
            for name in ("packed", *CODECS):
                began = time.perf_counter_ns()
                made = codecs.compress(n, config.lossless, config.level) if name == "packed" else codecs.ENCODERS[name](n, b) if b is not None else None
                row[name] = None if made is None else {"size": len(made), "micros": (time.perf_counter_ns() - began) // 1000}
            out.append(row)
        return pd.DataFrame(out, columns=["packed", *CODECS])

    return base_bytes(sketched, candidates).select("ord", "size", sizes("data", "base_data").alias("made")).select("ord", "size", "made.*")


def codec_events(sizes: DataFrame) -> DataFrame:
    """ord, method, block_reduction_ratio, micros: a row for each measurement of codec_sizes(); the ratio has four decimals."""
    named = [F.struct(F.lit("lossless" if c == "packed" else c).alias("method"), F.col(c).alias("m")) for c in ("packed", *CODECS)]
    rows = sizes.select("ord", "size", F.explode(F.array(*named)).alias("e")).where("e.m is not null")
    ratio = F.round(F.col("size") / F.nullif(F.col("e.m.size"), F.lit(0)), 4)
    return rows.select("ord", F.col("e.method").alias("method"), ratio.alias("block_reduction_ratio"), F.col("e.m.micros").alias("micros"))


def event_averages(events: DataFrame) -> DataFrame:
    return events.groupBy("method").agg(F.count("*").alias("n"), F.avg("micros").alias("avg_micros"), F.avg("block_reduction_ratio").alias("avg_ratio"))


def distribution(rows: DataFrame, by: str, value: str, points: int = 20, accuracy: int = 10_000) -> DataFrame:
    """by, share, value: the distribution function of a value within groups, at so many equal shares."""
    shares = [k / points for k in range(1, points + 1)]
    found = rows.groupBy(by).agg(F.percentile_approx(value, shares, accuracy).alias("v"))
    named = F.arrays_zip(F.array(*[F.lit(x) for x in shares]).alias("share"), F.col("v").alias("value"))
    return found.select(by, F.explode(named).alias("p")).select(by, F.col("p.share").alias("share"), F.col("p.value").alias("value"))


def codec_comparison(sketched: DataFrame, candidates: DataFrame, config: EngineConfig) -> DataFrame:
    """The outcome by codec over the same candidates."""
    rows = codec_sizes(sketched, candidates, config)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("codec"), F.col(f"{c}.size").alias("delta_size")) for c in CODECS]))
    rows = rows.select("size", F.col("packed.size").alias("self_size"), each.alias("e")).select("size", "self_size", "e.*")
    rows = rows.withColumn("kind", choose(F.col("size"), F.col("self_size"), F.col("delta_size")))
    stored = F.when(F.col("kind") == "delta", F.col("delta_size")).when(F.col("kind") == "lossless", F.col("self_size")).otherwise(F.col("size"))
    return rows.groupBy("codec", "kind").agg(F.count("*").alias("chunks"), F.sum(F.col("size").cast("long")).alias("bytes"), F.sum(stored.cast("long")).alias("stored"))

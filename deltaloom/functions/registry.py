"""SQL functions of the engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from deltaloom.config import EngineConfig
from deltaloom.functions import bytescan, codecs, vcdiff


def _scalar(f, returns: str):
    def call(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    if f.__code__.co_argcount == 1:
        return F.pandas_udf(lambda a: call(a), returns, F.PandasUDFType.SCALAR)
    if f.__code__.co_argcount == 3:
        return F.pandas_udf(lambda a, b, c: call(a, b, c), returns, F.PandasUDFType.SCALAR)
    return F.pandas_udf(lambda a, b: call(a, b), returns, F.PandasUDFType.SCALAR)


@F.udtf(returnType="idx int, offset long, size int")
class CdcChunkRows:
    """A row for each chunk of a binary, at the default sizes."""

    def eval(self, content: bytes):
        for i, (at, n, _) in enumerate(bytescan.chunks(content or b"", EngineConfig())):
            yield i, at, n


@F.udtf(returnType="idx int, op string, length long, offset long")
class DeltaInstructionRows:
    """A row for each instruction of a delta; the codec is gdelta or vcdiff."""

    def eval(self, delta: bytes, codec: str):
        listed = {"gdelta": codecs.gdelta_instructions, "vcdiff": codecs.vcdiff_instructions}[codec]
        for i, (op, n, at) in enumerate(listed(delta) if delta is not None else []):
            yield i, op, n, at


def register(spark: SparkSession, config: EngineConfig | None = None) -> list[str]:
    """Registers sketches, codecs and instruction listings, and the table functions cdc_chunk_rows and delta_instructions; returns
    their names."""
    config = config or EngineConfig()
    ops = "array<struct<op:string,length:int,offset:int>>"
    as_rows = lambda found: [{"op": o, "length": n, "offset": a} for o, n, a in found]
    found = {
        "bitmap_sketch": (lambda b: bytescan.signed(bytescan.bitmap_sketch(b)), "long"),
        "odess_features": (lambda b: bytescan.odess_features(b, config.features), "array<long>"),
        "ntransform_features": (lambda b: bytescan.ntransform_features(b, config.features), "array<long>"),
        "cdc_chunks": (lambda b: [{"offset": a, "size": n} for a, n, _ in bytescan.chunks(b, config)], "array<struct<offset:long,size:int>>"),
        "finesse_features": (lambda b: bytescan.finesse_features(b, config.features), "array<long>"),
        "gear_hash": (lambda b: bytescan.signed(bytescan.gear_hash(b)), "long"),
        "gdelta_hash_encode": (_two(lambda a, b: codecs.gdelta_sketch_encode(a, b, bytescan.bitmap_sketch(a), bytescan.bitmap_sketch(b))), "binary"),
        "vcdiff_merge": (lambda first, second, size: codecs.merge_deltas(first, second, int(size)), "binary"),
        "vcdiff_recode": (_two(lambda delta, secondary: vcdiff.recode(delta, bool(secondary))), "binary"),
        "zdelta_encode2": (lambda new, one, two: codecs.zdelta_encode(new, one, two, level=config.level if config.level > 0 else 6), "binary"),
        "zdelta_decode2": (lambda delta, one, two: codecs.zdelta_decode(delta, one, two), "binary"),
        "unpack_outer": (codecs.unpack_outer, "binary"),
        "zstd_size": (lambda b: len(codecs.compress(b, "zstd", config.level)), "int"),
        "lz4_size": (lambda b: len(codecs.compress(b, "lz4")), "int"),
        "gdelta_instructions": (lambda d: as_rows(codecs.gdelta_instructions(d)), ops),
        "vcdiff_instructions": (lambda d: as_rows(codecs.vcdiff_instructions(d)), ops),
    }
    for name, encode in codecs.ENCODERS.items():
        decode = codecs.DECODERS[name]
        found[f"{name}_encode"] = (_two(encode), "binary")
        found[f"{name}_decode"] = (_two(decode), "binary")
    for name, (f, returns) in found.items():
        spark.udf.register(name, _scalar(f, returns))
    tables = {"cdc_chunk_rows": CdcChunkRows, "delta_instructions": DeltaInstructionRows}
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return sorted([*found, *tables])


def _two(f):
    def call(a, b):
        return f(a, b)

    return call

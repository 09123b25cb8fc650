"""Run-time options of the reduction pipeline."""

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunker: str = "normalized"  # normalized, normalized2, plain, plain2, unified, fixed
    min_size: int = 6144
    normal_size: int = 8192
    max_size: int = 32768
    plain_min_size: int = 2048
    sketch: str = "bitmap"  # bitmap, odess, ntransform, finesse
    features: int = 3
    super_features: int = 3
    index: str = "latest"  # latest, cluster
    delta: str = "gdelta"  # gdelta, gdelta_left, gdelta_sketch, edelta, vcdiff, zdelta
    lossless: str = "zstd"  # zstd, lz4
    level: int = 1
    delta_post_compress: bool = True
    limit_fraction: float = 1.0  # the first part of the stream that is worked on
    scope: tuple[str, ...] = ()  # columns within which duplicates and bases are looked for; () is everywhere


SMALL = EngineConfig(min_size=512, normal_size=1024, max_size=4096, plain_min_size=256)

"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Pigeonhole blocks: a fingerprint is cut into five blocks; two fingerprints at distance three or less agree on
two blocks at least, so each distinct fingerprint is dealt under its ten pairs of blocks and only fingerprints
of one bucket are compared. A bucket that holds more than ``limit`` fingerprints is dealt again: its free bits
are cut into four blocks, of which a close pair shares one. The fifth level leaves at most 12 free bits, so no
bucket there holds more than 4096 distinct fingerprints. Within a bucket every pair is compared, but only a
spanning forest of the links leaves the task.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import connected_components, materialise, star_labels

DISTANCE = 3
LIMIT = 4096
LEVELS = 4
SEED = 42
_SLICE = 1 << 16


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    """XXH64 of every shingle of the lower-cased (A-Z) words; of the whole sequence where words are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    return [xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(size)))]


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is set where over half of the shingle hashes have it; no words give zero."""
    hashes = np.array(shingle_hashes(text, size), dtype=np.uint64)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = hashes[i : i + _SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long. A null or wordless text has fp 0."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], n: int) -> list[int]:
    """n masks of about equal size over the given bit positions."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), n)]


def _masks(level: int) -> dict[int, list[int]]:
    """The masks of a level, under the mask of the level above that each refines."""
    if level == 0:
        blocks = _cut(list(range(64)), DISTANCE + 2)
        return {0: [a | b for a, b in itertools.combinations(blocks, 2)]}
    above = {m for ms in _masks(level - 1).values() for m in ms}
    return {m: [m | part for part in _cut([b for b in range(64) if not m >> b & 1], DISTANCE + 1)] for m in above}


def _forest(batches):
    """Links within buckets (rows sorted by mask, value), as stars per bucket."""

    def links(mask, value, fp):
        start = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
        sizes = np.diff(np.r_[start, len(fp)])
        for s, n in zip(start[sizes > 256], sizes[sizes > 256]):
            yield from dense(fp[s : s + n])
        gid = np.repeat(np.arange(len(start)), sizes)
        keep = np.repeat((sizes > 1) & (sizes <= 256), sizes)
        gid, fp = gid[keep], fp[keep]
        found = []
        for shift in range(1, 256):
            same = np.flatnonzero(gid[shift:] == gid[:-shift])
            if not len(same):
                break
            a, b = fp[same], fp[same + shift]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE
            found.append((a[near], b[near]))
        if found and sum(len(a) for a, _ in found):
            yield star_labels(*(np.concatenate(c) for c in zip(*found)))

    def dense(fp):
        held = []
        for i in range(0, len(fp), 512):
            near = np.bitwise_count((fp[i : i + 512, None] ^ fp[None, i:]).view(np.uint64)) <= DISTANCE
            x, y = np.nonzero(near)
            x, y = fp[i : i + 512][x], fp[i:][y]
            held.append(star_labels(x[x != y], y[x != y]))
        yield star_labels(*(np.concatenate(c) for c in zip(*held)))

    def emit(rows):
        for nodes, low in links(*rows):
            keep = nodes != low
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], names=["u", "v"])

    rest = None
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest is not None:
            rows = [np.concatenate(p) for p in zip(rest, rows)]
        if not len(rows[0]):
            continue
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [r[cut:] for r in rows]
        if cut:
            yield from emit([r[:cut] for r in rows])
    if rest is not None and len(rest[0]):
        yield from emit(rest)


def links(spark: SparkSession, fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) between fingerprints (column fp, distinct) with the components of all links at DISTANCE or less."""
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("value"))
    edges = None
    for level in range(LEVELS + 1):
        table = F.create_map(
            *[x for m, subs in _masks(level).items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in subs]))]
        )
        rows = rows.select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        hot = None
        if level < LEVELS:
            hot = materialise(spark, rows.groupBy("mask", "value").count().where(F.col("count") > limit).drop("count"), "hot")
            hot = None if hot.isEmpty() else hot
        calm = rows if hot is None else rows.join(hot, ["mask", "value"], "left_anti")
        found = (
            calm.select("mask", "value", "fp")
            .repartition(F.col("mask"), F.col("value"))
            .sortWithinPartitions("mask", "value", "fp")
            .mapInArrow(_forest, "u long, v long")
        )
        edges = found if edges is None else edges.unionByName(found)
        if hot is None:
            return edges
        rows = materialise(spark, rows.join(hot, ["mask", "value"], "left_semi").select("fp", "mask", "value"), "dealt").distinct()
    return edges


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links).

    Rows with a null or wordless text share fingerprint zero and are linked like any other. Repeated ids give
    a row each. A null id never becomes a component's id unless no member has one. An empty table gives none.
    Other columns of docs are ignored.
    """
    fps = materialise(spark, fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = materialise(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(spark, links(spark, nodes, limit)).withColumnsRenamed({"node": "fp"})
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialise(spark, nodes.join(least, "root").select("fp", "component_id"), "labels")
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The wide fingerprint: its bits and shingle words, for a similarity of 0.8.
WIDE_BITS, WIDE_WORDS, SIMILARITY = 256, 5, 0.8
#: Standard deviations above the expected distance at which a pair is still a candidate.
DEVIATIONS = 4
#: Share of the pairs at the similarity that may miss each other's buckets, and fingerprints of a bucket that chance alone brings together.
MISSED, BUCKET = 1e-3, 512
WIDE_LIMIT = 32768
_WORDS = ("w0", "w1", "w2", "w3")


def _shingles(text: str | None, size: int) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(s) for s in zip(*(words[i:] for i in range(size)))}


def shingle_set(text: str | None, size: int = WIDE_WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    from xxhash import xxh3_64_intdigest

    return np.unique(np.array([xxh3_64_intdigest(s, 3) for s in _shingles(text, size)], dtype=np.uint64))


def set_digest(text: str | None, size: int = WIDE_WORDS) -> tuple[int, int]:
    """128 bits of the set of shingles, as two signed longs."""
    return _digest(sorted(_shingles(text, size)))


def _digest(shingles: list[bytes]) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(b"\n".join(shingles), 5), np.int64).tolist())


def wide_fingerprint(text: str | None, size: int = WIDE_WORDS) -> np.ndarray:
    """Four 64-bit words: a bit is set where at least half of the distinct shingles' hashes have it."""
    return _wide(sorted(_shingles(text, size)))


def _wide(shingles: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_128_digest

    if not shingles:
        return np.zeros(4, dtype=np.int64)
    counts = np.zeros(WIDE_BITS, dtype=np.int64)
    for i in range(0, len(shingles), _SLICE):
        raw = b"".join([xxh3_128_digest(s, 1) + xxh3_128_digest(s, 2) for s in shingles[i : i + _SLICE]])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 32), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts >= len(shingles)).view(np.int64)


def max_distance(similarity: float = SIMILARITY, bits: int = WIDE_BITS, deviations: float = DEVIATIONS) -> int:
    """Differing bits of two sets of equal size with this Jaccard similarity: the mean and so many deviations, rounded up."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WIDE_WORDS) -> DataFrame:
    """doc_id, the digest of the set of shingles (s0, s1) and the fingerprint's words."""

    def run(batches):
        for batch in batches:
            texts = (t for i in range(0, batch.num_rows, 256) for t in batch.column(1).slice(i, 256).to_pylist())
            found = np.zeros((batch.num_rows, 6), dtype=np.int64)
            for row, text in zip(found, texts):
                shingles = sorted(_shingles(text, size))
                row[:2] = _digest(shingles)
                row[2:] = _wide(shingles)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k].copy()) for k in range(6)]], names=["doc_id", "s0", "s1", *_WORDS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, s0 long, s1 long, w0 long, w1 long, w2 long, w3 long"
    )


def key_plan(rows: int, similarity: float = SIMILARITY, missed: float = MISSED, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits of a key, number of keys) for so many fingerprints.

    A bit more for each doubling of the rows keeps chance meetings at about ``bucket`` for a bucket, so comparisons grow with
    rows x keys and not with the square; the number of keys follows, so that the share of the pairs at ``similarity`` that
    agree on no key stays ``missed`` at every size. The distance of such pairs is binomial; its spread is summed out.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    k = int(np.clip(np.ceil(np.log2(max(rows, 1) / bucket)), 4, 48))
    d = np.arange(WIDE_BITS + 1)
    logs = np.cumsum(np.log(np.maximum(d, 1)))
    share = np.exp(logs[-1] - logs - logs[::-1] + d * np.log(p) + (WIDE_BITS - d) * np.log1p(-p))
    meets = np.clip(np.array([np.prod(np.clip((WIDE_BITS - x - np.arange(k)) / (WIDE_BITS - np.arange(k)), 0, 1)) for x in d]), 0, 1 - 1e-12)
    low, high = 1, 1 << 24
    while low < high:
        n = (low + high) // 2
        low, high = (low, n) if (share * (1 - meets) ** n).sum() <= missed else (n + 1, high)
    return k, low


def _deal(bits: int, keys: int):
    """A row (bucket, id, words) for each key of a row (id, words); a key is a seeded choice of so many bits."""

    def run(batches):
        own = np.stack([np.random.default_rng([SEED, k]).permutation(WIDE_BITS)[:bits] for k in range(keys)])
        places = np.int64(1) << np.arange(bits, dtype=np.int64)
        step = max(1, (1 << 18) // keys)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                ids, *words = (c.to_numpy(zero_copy_only=False) for c in batch.slice(i, step).columns)
                raw = np.unpackbits(np.stack(words, axis=1).view(np.uint8), axis=1)
                values = np.stack([raw[:, o].astype(np.int64) @ places for o in own], axis=1)
                buckets = (values * keys + np.arange(keys)).ravel()
                columns = [buckets, *(np.repeat(c, keys) for c in (ids, *words))]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["bucket", "id", *_WORDS])

    return run


def _runs(batches, emit):
    """Calls emit(columns, starts) so that each run of one value in the first column is met whole; starts hold its end too."""
    rest = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = rows if rest is None else [np.concatenate(p) for p in zip(rest, rows)]
        if not len(rows[0]):
            continue
        starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        yield from emit(rows, starts)
        rest = [r[starts[-1] :] for r in rows]
    if rest is not None:
        yield from emit(rest, [0, len(rest[0])])


def _stars(found):
    if found:
        nodes, low = (np.concatenate(c) for c in zip(*found))
        keep = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(low[keep])], names=["u", "v"])


def _wide_forest(most: int):
    """Links (ids of fingerprints at most ``most`` bits apart) within runs of one bucket; rows (bucket, id, words)."""

    def compare(ids, fps):
        """Least linked neighbours first: a spanning forest, from blocks of some rows x all."""
        held, step = [], max(1, min(256, (1 << 21) // len(ids)))
        for i in range(0, len(ids), step):
            left, right = fps[i : i + step], fps[i:]
            apart = sum((np.bitwise_count(left[:, None, k] ^ right[None, :, k]) for k in (1, 2)), np.bitwise_count(left[:, None, 0] ^ right[None, :, 0]))
            x, y = np.nonzero(apart <= most)  # three words: at most 192, within a byte
            near = apart[x, y].astype(np.int64) + np.bitwise_count(left[x, 3] ^ right[y, 3]) <= most
            x, y = ids[i : i + step][x[near]], ids[i:][y[near]]
            held.append((x[x != y], y[x != y]))
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [star_labels(*(np.concatenate(c) for c in zip(*held)))]
        return star_labels(*(np.concatenate(c) for c in zip(*held)))

    def emit(rows, starts):
        found = []
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                found.append(compare(rows[1][a:b], np.stack([r[a:b] for r in rows[2:]], axis=1).view(np.uint64)))
        yield from _stars(found)

    return lambda batches: _runs(batches, emit)


def exact_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and least nodes of the components of all pairs of sets with a Jaccard similarity of at least ``similarity``.

    Breadth first: a set meets those not reached yet, so a group of near copies costs about one pass for each of them at most.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    ends = np.cumsum(sizes)
    left, u, v = np.ones(len(sets), dtype=bool), [], []
    rest_flat, rest_owner = flat, owner
    for root in range(len(sets)):
        if not left[root]:
            continue
        queue, left[root] = [root], False
        while queue and left.any():
            i = queue.pop()
            mark = np.zeros(len(values), dtype=bool)
            mark[flat[ends[i] - sizes[i] : ends[i]]] = True
            common = np.bincount(rest_owner[mark[rest_flat]], minlength=len(sets))
            near = np.flatnonzero(left & (common >= similarity * (sizes + sizes[i] - common) - 1e-9) & (common > 0))
            left[near] = False
            queue.extend(near.tolist())
            u.extend([ids[i]] * len(near))
            v.extend(ids[near].tolist())
            if 2 * sizes[left].sum() < len(rest_flat):
                keep = left[rest_owner]
                rest_flat, rest_owner = rest_flat[keep], rest_owner[keep]
    return star_labels(np.array(u, dtype=np.int64), np.array(v, dtype=np.int64))


def _rows_once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (bucket, id, text, ...) of a batch without those that repeat all three: copies of one document under one id."""
    codes = [c.to_numpy() for c in (batch.column(0), batch.column(1))] + [batch.column(2).dictionary_encode().indices.fill_null(-1).to_numpy()]
    first = np.unique(np.stack(codes, axis=1), axis=0, return_index=True)[1]
    return batch if len(first) == batch.num_rows else batch.take(pa.array(np.sort(first)))


def _ids_once(rows: list[np.ndarray], starts) -> tuple[list[np.ndarray], np.ndarray]:
    """Of neighbouring rows with one bucket and id (sorted so) the first; starts are moved accordingly."""
    new = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
    place = np.r_[0, np.cumsum(new)]
    return [r[new] for r in rows], place[np.asarray(starts)]


def _verified(similarity: float):
    """Exact links within runs of one bucket; rows (bucket, id, shingles as bytes)."""

    def emit(rows, starts):
        found = []
        rows, starts = _ids_once(rows, starts)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 1:
                found.append(exact_links(rows[1][a:b], [np.frombuffer(r, np.uint64) for r in rows[2][a:b]], similarity))
        yield from _stars(found)

    return lambda batches: _runs(batches, emit)


def _parted(spark: SparkSession, dealt: DataFrame, limit: int) -> DataFrame:
    """Cuts the buckets of more than ``limit`` rows into parts by hash of the id, every two of which share a bucket."""
    big = materialise(spark, dealt.groupBy("bucket").count().where(F.col("count") > limit), "big")
    if big.isEmpty():
        return dealt
    columns = [c for c in dealt.columns if c != "bucket"]
    big = big.select("bucket", F.ceil(2 * F.col("count") / limit).cast("long").alias("parts"))
    dealt = dealt.join(big, "bucket", "left")
    part, parts = F.pmod(F.xxhash64("id"), F.col("parts")), F.col("parts")
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), parts - 1),
        lambda o: F.xxhash64("bucket", F.least(part, o), F.greatest(part, o)),
    )
    return dealt.select(F.explode(F.coalesce(pairs, F.array(F.col("bucket")))).alias("bucket"), *columns)


def _labelled(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, limit: int, exact_limit: int) -> DataFrame:
    """doc_id, s0, s1, root: each row's set of shingles (a 128-bit digest) and the number of its group."""
    docs = docs.where(F.col(id_col).isNotNull())
    fps = materialise(spark, wide_fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = fps.groupBy("s0", "s1").agg(F.min("doc_id").alias("least"), *[F.first(w).alias(w) for w in _WORDS])
    # numbers are fixed by the writing: they name sets, as different sets may share a doc_id
    nodes = materialise(spark, nodes.withColumn("id", F.monotonically_increasing_id()), "classes")
    bits, keys = key_plan(nodes.count(), similarity)
    dealt = nodes.select("id", *_WORDS).mapInArrow(_deal(bits, keys), "bucket long, id long, " + ", ".join(f"{w} long" for w in _WORDS))
    dealt = _parted(spark, dealt, limit)
    maybe = dealt.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_wide_forest(max_distance(similarity)), "u long, v long")
    maybe = materialise(spark, connected_components(spark, maybe).select(F.col("node").alias("id"), F.col("root").alias("bucket")), "candidates")

    def hashed(batches):
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["bucket", "id", "shingles"])

    # a text for each candidate set, found by a doc_id that has it; rows of that id with another text are told by their digest
    wanted = nodes.select("id", "least", "s0", "s1").join(_parted(spark, maybe, exact_limit).hint("merge"), "id")
    texts = docs.select(F.col(id_col).cast("long").alias("least"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(wanted.hint("merge"), "least").select("bucket", "id", "text", "s0", "s1")

    def own(batches):
        for batch in batches:
            batch = _rows_once(batch)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                digests = np.array([set_digest(t, size) for t in part.column(2).to_pylist()], dtype=np.int64).reshape(-1, 2)
                same = (digests[:, 0] == part.column(3).to_numpy()) & (digests[:, 1] == part.column(4).to_numpy())
                yield from hashed([part.filter(pa.array(same))])

    sets = texts.mapInArrow(own, "bucket long, id long, shingles binary").repartition("bucket").sortWithinPartitions("bucket", "id")
    edges = sets.mapInArrow(_verified(similarity), "u long, v long")
    roots = connected_components(spark, edges).withColumnsRenamed({"node": "id"})
    labels = nodes.join(roots, "id", "left").select("s0", "s1", F.coalesce("root", "id").alias("root"))
    return fps.select("doc_id", "s0", "s1").join(materialise(spark, labels, "labels"), ["s0", "s1"])


def similar_groups(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WIDE_WORDS,
    similarity: float = SIMILARITY,
    limit: int = WIDE_LIMIT,
    exact_limit: int = LIMIT,
) -> DataFrame:
    """(doc_id, component_id) for documents whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Candidates come from wide fingerprints: at 0.8 about 39 of 256 bits differ, and a pair is a candidate up to four
    standard deviations more (62). Fingerprints meet if they agree on one of the seeded keys of key_plan(): all but
    MISSED of the pairs at the similarity do by calculation, at every size. Within a component of candidates every pair
    that matters is then decided by the sets themselves, so no pair below the similarity is linked. Equal sets count
    once. A bucket of more than ``limit`` fingerprints (a component of more than ``exact_limit`` sets) is cut into parts
    by hash, and every two parts meet in a task of their own. A row for each row with an id; texts without words are
    one group. Null and empty texts count as without words; other columns are ignored; an empty table gives none.
    """
    rows = _labelled(spark, docs, id_col, text_col, size, similarity, limit, exact_limit)
    least = materialise(spark, rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select("doc_id", "component_id")


def keep_one(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WIDE_WORDS, similarity: float = SIMILARITY,
    limit: int = WIDE_LIMIT, exact_limit: int = LIMIT,
) -> DataFrame:
    """The rows of docs less near copies: of each group one row with the least doc_id; rows without an id stay.

    Decisions are made by row: different texts that share a doc_id are groups of their own, and a copy of one of them takes
    the other with it no more. Rows that share both doc_id and set of shingles count as copies, and the one whose text sorts
    first stays. Null and empty texts are one group. Columns, of any name, and types are those of docs.
    """
    rows = _labelled(spark, docs, id_col, text_col, size, similarity, limit, exact_limit)
    sets = rows.groupBy("doc_id", "s0", "s1").agg(F.min("root").alias("root"), F.count("*").alias("n"))
    sets = materialise(spark, sets, "sets")
    stays = sets.groupBy("root").agg(F.min(F.struct("doc_id", "s0", "s1")).alias("first"))
    stays = materialise(spark, stays.select("first.*"), "stays")
    by_id = sets.groupBy("doc_id").agg(F.sum("n").alias("n"))
    kept_ids = stays.groupBy("doc_id").agg(F.lit(True).alias("some"))
    by_id = materialise(spark, by_id.join(kept_ids, "doc_id", "left"), "ids")
    # whole rows travel as one struct, so no name of theirs can clash
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"))
    gone = by_id.where("some is null or n > 1").select(F.col("doc_id").alias("_id")).hint("merge")  # grows with the corpus: never broadcast
    kept = whole.join(gone, "_id", "left_anti")
    mixed = by_id.where("some and n > 1").select(F.col("doc_id").alias("_id"))
    if not mixed.isEmpty():

        def marked(batches):
            for batch in batches:
                texts = batch.column(2).to_pylist()
                found = np.array([set_digest(t, size) for t in texts], dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["_row", "_id", "_text", "_s0", "_s1"])

        again = whole.join(mixed, "_id", "left_semi").select("_row", "_id", F.col(f"_row.`{text_col}`").cast("string").alias("_text"))
        row_type = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).schema["_row"].dataType.simpleString()
        again = again.mapInArrow(marked, f"_row {row_type}, _id long, _text string, _s0 long, _s1 long")
        first = stays.select(F.col("doc_id").alias("_id"), F.col("s0").alias("_s0"), F.col("s1").alias("_s1"))
        again = again.join(first, ["_id", "_s0", "_s1"], "left_semi").groupBy("_id", "_s0", "_s1").agg(F.min_by("_row", F.coalesce("_text", F.lit(""))).alias("_row"))
        kept = kept.select("_row").unionByName(again.select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by cell of source, language and topic. A topic is a cluster of texts that use words alike, fitted on
all texts, unless the documents bring a column of their own. Raking scales the cells until their marginals meet
the targets of each dimension; a cell's weight is raked over present tokens. Documents are then drawn by a hash of
their id with a number of copies expected in proportion to their cell's weight, so that expected tokens have the
target mix. Every value has a marginal of its own: up to MOST_CELLS cells are raked on the driver, more by Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import materialise, worker_cache

DIMENSIONS = ("source", "lang", "topic")
OTHER = "(other)"
#: Cells that are raked on the driver; the same rounds run over a table where there are more.
MOST_CELLS = 100_000
#: Share of the raked tokens, at most, in the cells of the largest weights that are expected more than once.
RARE = 1e-3
POWER = 0.9
ROUNDS, TOLERANCE = 200, 1e-10


#: Topics, the slots that words are hashed into, rounds of the clusters, and texts that are tried for each one's start.
TOPICS, SLOTS, CLUSTER_ROUNDS, TRIES = 8, 512, 8, 8
_CACHE_WORDS = 400_000
#: Sums over texts are kept in whole steps of this size, so that they don't depend on an order.
STEP = 2.0**-30
#: Texts to a part of the table that topics are fitted on, about, and to a block.
PART, BLOCK = 8_192, 512
_SLOT = np.dtype([("slot", "<u2"), ("n", "<u4")])


class _Slots(dict):
    """Slots of words, each found when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = crc32(word) % SLOTS
        return slot


class Topics:
    """Clusters of hashed word counts of all texts. Weights lift the slots that few texts use.

    ``passes`` calls a function with the blocks (hashes, counts of words by slot) of each part of the texts and returns what it
    gives for each. Starts are drawn one by one by their squared distance to those before, each the best of TRIES: by the least
    of exponential variates, which come from the hashes. Then all texts go through CLUSTER_ROUNDS rounds of k-means.
    """

    def __init__(self, texts: list[str | None], topics: int = TOPICS, seed: int = 0):
        counts = np.stack([self.counts(t) for t in texts]) if texts else np.zeros((0, SLOTS), dtype=np.int64)
        rows = counts.any(axis=1)
        block = (np.arange(len(counts), dtype=np.uint64)[rows], counts[rows])
        self._fit(lambda part: [part(iter([block]))], topics, seed)

    @classmethod
    def over(cls, passes: Callable[[Callable], list], topics: int = TOPICS, seed: int = 0) -> Topics:
        found = cls.__new__(cls)
        found._fit(passes, topics, seed)
        return found

    def _fit(self, passes: Callable[[Callable], list], topics: int, seed: int) -> None:
        found = passes(partial(_frequencies, seed=seed))
        n = sum(f[0] for f in found)
        self.weights = np.log((1 + n) / (1 + sum((f[1] for f in found), np.zeros(SLOTS, dtype=np.int64))))
        self.centers = np.zeros((1, SLOTS))
        if not n:
            return
        tried, centers = [min(f for _, _, first in found for f in first)], np.zeros((0, SLOTS))
        while tried and len(centers) < topics:
            rows = self._units(np.stack([_dense([t[2]])[0] for t in tried]))
            seen = passes(partial(_distances, topics=self, centers=centers, tried=rows, seed=seed + 1 + len(centers)))
            best = int(np.argmin(sum(s[0] for s in seen)))
            centers = np.vstack([centers, rows[best]])
            tried = sorted(t for s in seen for t in s[1][best])[:TRIES]
        self.centers = centers
        for _ in range(CLUSTER_ROUNDS):
            found = passes(partial(_members, topics=self))
            size, total = sum(f[0] for f in found), sum(f[1] for f in found)
            moved = np.where(size[:, None] > 0, total * STEP / np.maximum(size, 1)[:, None], self.centers)
            same, self.centers = np.array_equal(moved, self.centers), moved
            if same:
                break

    @staticmethod
    def counts(text: str | None) -> np.ndarray:
        """How many words of a text fall into each slot."""
        slots = worker_cache("mixing").setdefault("slots", _Slots())
        if len(slots) > _CACHE_WORDS:
            slots.clear()
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        return np.bincount(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), minlength=SLOTS)

    def _units(self, counts: np.ndarray) -> np.ndarray:
        x = np.sqrt(counts) * self.weights
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centers**2).sum(1)[None] - 2 * x @ self.centers.T).argmin(1)

    def name(self, counts: np.ndarray) -> np.ndarray:
        """Topics of rows of counts; texts without words have none."""
        near = self._nearest(self._units(counts))
        return np.where(counts.any(axis=1), np.char.add("topic", near.astype(str)), "none")


def _sparse(counts: np.ndarray) -> bytes:
    slots = np.flatnonzero(counts)
    out = np.empty(len(slots), dtype=_SLOT)
    out["slot"], out["n"] = slots, counts[slots]
    return out.tobytes()


def _dense(packed: list[bytes]) -> np.ndarray:
    found = np.frombuffer(b"".join(packed), _SLOT)
    out = np.zeros((len(packed), SLOTS))
    out[np.repeat(np.arange(len(packed)), [len(p) // _SLOT.itemsize for p in packed]), found["slot"]] = found["n"]
    return out


def _exponential(hashes: np.ndarray, seed: int) -> np.ndarray:
    """Exponential variates that follow from hashes."""
    z = hashes + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return -np.log(((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54)


def _least(keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int) -> list[tuple[float, int, bytes]]:
    """(key, hash, packed counts) of the rows with the n least keys."""
    rows = np.argsort(keys, kind="stable")[:n]
    return [(float(keys[i]), int(hashes[i]), _sparse(counts[i])) for i in rows if np.isfinite(keys[i])]


def _frequencies(blocks, seed: int) -> tuple[int, np.ndarray, list]:
    """Texts, the texts that use each slot, and the text with the least variate."""
    n, used, first = 0, np.zeros(SLOTS, dtype=np.int64), []
    for hashes, counts in blocks:
        n, used = n + len(counts), used + (counts > 0).sum(axis=0)
        first = sorted(first + _least(_exponential(hashes, seed), hashes, counts, 1))[:1]
    return n, used, first


def _distances(blocks, topics: Topics, centers: np.ndarray, tried: np.ndarray, seed: int) -> tuple[np.ndarray, list]:
    """For each text tried: the sum of squared distances that it would leave, and the next ones to try."""
    left, drawn = np.zeros(len(tried), dtype=np.int64), [[] for _ in tried]
    for hashes, counts in blocks:
        x = topics._units(counts)
        squares = (x**2).sum(1)[:, None]
        to = lambda c: np.maximum(squares + (c**2).sum(1)[None] - 2 * x @ c.T, 0)
        far = np.minimum(to(centers).min(axis=1, initial=np.inf)[:, None], to(tried))
        left += np.round(far / STEP).astype(np.int64).sum(axis=0)
        variates = _exponential(hashes, seed)
        for k in range(len(tried)):
            keys = np.where(far[:, k] > 1e-12, variates / np.maximum(far[:, k], 1e-12), np.inf)
            if len(drawn[k]) < TRIES or keys.min(initial=np.inf) < drawn[k][-1][0]:
                drawn[k] = sorted(drawn[k] + _least(keys, hashes, counts, TRIES))[:TRIES]
    return left, drawn


def _members(blocks, topics: Topics) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum (in steps) of the texts nearest to each center."""
    k = len(topics.centers)
    size, total = np.zeros(k, dtype=np.int64), np.zeros((k, SLOTS), dtype=np.int64)
    for _, counts in blocks:
        x = topics._units(counts)
        near = topics._nearest(x)
        size += np.bincount(near, minlength=k)
        steps = np.round(x / STEP)
        total += np.stack([steps[near == c].sum(axis=0) for c in range(k)]).astype(np.int64)
    return size, total


def fit_topics(spark: SparkSession, docs: DataFrame, text_col: str = "text", topics: int = TOPICS) -> Topics:
    """Topics of all texts with words; equal texts count once. Their counts of words are a table, over which every step goes."""
    text = F.col(f"`{text_col}`").cast("string")

    def count(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                packed = pa.array([_sparse(Topics.counts(t)) for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["h", "packed"])

    counted = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(count, "h long, packed binary")
    counted = counted.where(F.octet_length("packed") > 0).groupBy("h").agg(F.min("packed").alias("packed"))
    table = materialise(spark, counted.repartition(max(1, -(-docs.count() // PART)), "h"), "words")

    def passes(part):
        def run(batches):
            def blocks():
                for batch in batches:
                    for i in range(0, batch.num_rows, BLOCK):
                        rows = batch.slice(i, BLOCK)
                        yield rows.column(0).to_numpy().view(np.uint64), _dense(rows.column(1).to_pylist())

            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part(blocks()))], pa.binary())], names=["found"])

        return [pickle.loads(f) for f in table.mapInArrow(run, "found binary").toArrow()["found"].to_pylist()]

    return Topics.over(passes, topics)


def tempered(totals: dict[str, float], power: float = POWER) -> dict[str, float]:
    """Target shares: present shares to a power below one lift the rare values."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Raked tokens of the cells (row: value number in each dimension) with the present total; targets are shares.

    Shares of values that no cell has are spread over the others. Stops at the tolerance or after the rounds.
    """
    weights = tokens.astype(float).copy()
    total = weights.sum()
    for _ in range(rounds):
        worst = 0.0
        for d, target in enumerate(targets):
            now = np.bincount(cells[:, d], weights, minlength=len(target))
            share = np.where(now > 0, target, 0)
            want = total * share / max(share.sum(), 1e-300)
            factor = np.divide(want, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor - 1).max(initial=0)))
            weights *= factor[cells[:, d]]
        if worst < TOLERANCE:
            break
    return weights


def described(
    docs: DataFrame, topics: Topics | None = None, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, whole: bool = False
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, and with ``whole`` the row itself as a struct, so that its names can't clash.

    Null sources, languages and given topics count as OTHER; tokens are the words told apart by ASCII white space. Topics
    are needed unless a column has them.
    """
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(OTHER))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * whole
    given = value(topic_col) if topic_col else F.lit(None).cast("string")
    rows = docs.select(
        *own, F.col(f"`{id_col}`").cast("long").alias("doc_id"), value("source").alias("source"), value("lang").alias("lang"), given.alias("topic"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    names = [*rows.columns[:-2], "topic", "n_tokens"]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(part.num_columns - 1).to_pylist()
                if topic_col:
                    n = np.array([len((t or "").encode("utf-8", "surrogatepass").split()) for t in texts], dtype=np.int64)
                    topic = part.column(part.num_columns - 2)
                else:
                    counts = np.stack([Topics.counts(t) for t in texts])
                    n, topic = counts.sum(axis=1), pa.array(topics.name(counts).tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], topic, pa.array(n)], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names[:-1]) + ", n_tokens long")


def _scale(weight: np.ndarray, tokens: np.ndarray, size: float | None) -> float:
    """The weight of one expected copy: of the present tokens the share ``size`` is expected, or else see RARE."""
    if size is not None:
        return float((weight * tokens).sum() / (size * tokens.sum()))
    order = np.argsort(-weight, kind="stable")
    held = np.cumsum((weight * tokens)[order])
    return float(weight[order][np.searchsorted(held, RARE * held[-1], side="right")])


def _raked_here(cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    found = cells.toArrow().sort_by([(d, "ascending") for d in DIMENSIONS])
    tokens, numbers, shares = found["tokens"].to_numpy().astype(float), [], []
    for d in DIMENSIONS:
        names, number = np.unique(np.array(found[d].to_pylist(), dtype=object), return_inverse=True)
        present = dict(zip(names, np.bincount(number, tokens, minlength=len(names))))
        wanted = (targets or {}).get(d) or tempered(present, power)
        numbers.append(number)
        shares.append(np.array([wanted.get(n, 0.0) for n in names]))
    weights = rake(np.stack(numbers, axis=1), tokens, shares)
    return [found[d].to_pylist() for d in DIMENSIONS], tokens, weights / tokens


def _raked_there(spark: SparkSession, cells: DataFrame, targets: dict[str, dict[str, float]] | None, power: float) -> DataFrame:
    """rake() with the cells and the shares in tables: source, lang, topic, tokens, weight."""
    total = float(cells.agg(F.sum("tokens")).first()[0])
    wanted = {}
    for d in DIMENSIONS:
        own = (targets or {}).get(d)
        if own:
            wanted[d] = spark.createDataFrame([(k, float(v)) for k, v in own.items()], f"{d} string, share double")
        else:
            wanted[d] = materialise(spark, cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("share")), "shares")
    cells = cells.withColumn("mass", F.col("tokens").cast("double"))
    for _ in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            now = cells.groupBy(d).agg(F.sum("mass").alias("now")).join(wanted[d], d, "left")
            now = now.withColumn("share", F.when(F.col("now") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0))
            now = materialise(spark, now, "marginals")
            whole = max(now.agg(F.sum("share")).first()[0], 1e-300)
            factors = now.select(d, F.when(F.col("now") > 0, F.col("share") * (total / whole) / F.col("now")).otherwise(1.0).alias("factor"))
            worst = max(worst, factors.agg(F.max(F.abs(F.col("factor") - 1))).first()[0])
            cells = cells.join(factors, d).withColumn("mass", F.col("mass") * F.col("factor")).drop("factor")
        cells = materialise(spark, cells.select(*DIMENSIONS, "tokens", "mass"), "raked")
        if worst < TOLERANCE:
            break
    return cells.select(*DIMENSIONS, "tokens", (F.col("mass") / F.col("tokens")).alias("weight"))


def _scale_there(raked: DataFrame, size: float | None) -> float:
    """_scale() of a table: the marked weight is found by halving the weights' logarithms, without a sort in one task."""
    mass = F.col("weight") * F.col("tokens")
    whole, tokens, low, high = raked.where("weight > 0").agg(F.sum(mass), F.sum("tokens"), F.min("weight"), F.max("weight")).first()
    if size is not None:
        return float(whole / (size * tokens))
    for _ in range(60):
        middle = float(np.sqrt(low * high))
        if not low < middle < high:
            break
        above = raked.where(F.col("weight") > middle).agg(F.sum(mass)).first()[0] or 0.0
        low, high = (low, middle) if above <= RARE * whole else (middle, high)
    return float(raked.where(F.col("weight") <= high).agg(F.max("weight")).first()[0])


def cell_weights(
    spark: SparkSession, described_docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER,
    size: float | None = None, most_cells: int = MOST_CELLS,
) -> tuple[DataFrame, bool]:
    """source, lang, topic, weight, probability of each cell with tokens, and whether they are few enough to be broadcast.

    targets: shares by dimension and value; dimensions left out take the present shares to the power. probability is
    the expected number of copies of a document; it exceeds 1 only in cells that hold RARE of the raked tokens
    together, or where ``size`` (expected tokens over present ones) asks for it.
    """
    cells = described_docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    cells = materialise(spark, cells, "cells")
    n = cells.count()
    schema = "source string, lang string, topic string, weight double, probability double"
    if not n:
        return spark.createDataFrame([], schema), True
    if n > most_cells:
        raked = _raked_there(spark, cells, targets, power)
        return raked.select(*DIMENSIONS, "weight", (F.col("weight") / _scale_there(raked, size)).alias("probability")), False
    names, tokens, weight = _raked_here(cells, targets, power)
    chance = weight / _scale(weight, tokens, size)
    return spark.createDataFrame(list(zip(*names, weight.tolist(), chance.tolist())), schema), True


def uniform(column: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the hash of an id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 11) / F.lit(float(1 << 53))


def _with_cells(rows: DataFrame, cells: tuple[DataFrame, bool]) -> DataFrame:
    """Adds weight, probability and copies to described rows. Without tokens: 1 each, as they change no share."""
    table, few = cells
    found = rows.join(F.broadcast(table) if few else table, list(DIMENSIONS), "left")
    has = F.col("n_tokens") > 0
    return found.withColumns({c: F.when(has, F.col(c)).otherwise(1.0) for c in ("weight", "probability")})


def _copies(doc_id: Column, probability: Column, seed: int) -> Column:
    """The whole part of the expected copies, and one more where the hash of the id is below the rest."""
    whole = F.floor(probability)
    return (whole + (uniform(doc_id, seed) < probability - whole).cast("long")).cast("int")


def sample(
    spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, seed: int = 0,
    size: float | None = None, most_cells: int = MOST_CELLS, topic_col: str | None = None,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept, copies of each document.

    weight is the raked over the present tokens of the cell; probability is the expected number of copies (see
    cell_weights), copies the number drawn by the hash of the id (rows that repeat an id, or have none, share their draw
    if they share a cell), and kept says that it is not 0. Null and empty texts have no tokens: they change no share and
    stay once. An empty table gives none; columns other than doc_id, text, source, lang (and topic_col) are ignored.
    """
    topics = None if topic_col else fit_topics(spark, docs)
    documents = materialise(spark, described(docs, topics, topic_col=topic_col), "described")
    found = _with_cells(documents, cell_weights(spark, documents, targets, power, size, most_cells))
    copies = _copies(F.col("doc_id"), F.col("probability"), seed)
    return found.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", (copies > 0).alias("kept"), copies.alias("copies"))


def mixed(
    spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = POWER, seed: int = 0,
    size: float | None = None, most_cells: int = MOST_CELLS, topic_col: str | None = None,
) -> DataFrame:
    """The rows of docs that sample() keeps, each as often as it has copies; no join on ids.

    Columns, of any name, and types are those of docs. Nulls, repeats and empty tables as in sample().
    """
    topics = None if topic_col else fit_topics(spark, docs)
    cells = cell_weights(spark, described(docs, topics, topic_col=topic_col), targets, power, size, most_cells)
    found = _with_cells(described(docs, topics, topic_col=topic_col, whole=True), cells)
    found = found.select("row", _copies(F.col("doc_id"), F.col("probability"), seed).alias("copies")).where("copies > 0")
    found = found.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

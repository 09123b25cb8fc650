"""Embedding near-duplicates by product quantisation.

Unit vectors are dealt to inverted lists (the nearest of K coarse centroids); the residual of each is coded in subspaces.
A query probes every list whose border with its own list is within reach, and a link counts for both ends whichever of them finds
it: at a reach of half the linked distance none is missed. A shorter reach is measured on the sample, by distances to borders along
its own directions, whatever its geometry. Inside a list, the distance of the query to each decoded code (asymmetric) is a product
of matrices, and codes that the quantisation error cannot rule out are compared by exact cosine in double precision. Equal vectors
count once, with their number.

Vectors go to tasks in blocks: once for their list, and once for each group of lists in which they probe any.

Centroids and codebooks are fitted on a bounded sample; every vector is indexed and every vector is a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import connected_components, materialise, share_of, star_labels

COSINE = 0.95
#: Vectors of the sample that centroids, codebooks and the reach are fitted on: about so many, or PER_LIST for each list.
TRAIN_ROWS, PER_LIST, SUBSPACES, CODES = 16_384, 4, 8, 256
#: Lists are about the square root of the vectors, up to what a sample of this many can support.
MOST_TRAIN = 1 << 18
#: Share of the sample's trial pairs, made at the largest linked distance, that the reach must cover; trial vectors, and
#: neighbours of each that give a direction.
COVERED, TRIALS, NEIGHBOURS = 0.998, 4_096, 4
BLOCK = 2_048
#: Groups of lists at least, and bytes of a group's vectors at most (as single floats); partitions of cells at most.
GROUPS, BASE_BYTES, MOST_TASKS = 12, 1 << 24, 4_096
#: Bytes of vectors that are packed at a time and of queries that a task takes at a time; sizes of the blocks in which they meet a list.
PACKED_BYTES, ASKED_BYTES, ROWS, BASE = 1 << 21, 1 << 22, 512, 4_096
#: So many edges are few: one task finds their components.
AT_ONCE = 1_000_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), dtype=np.int64)
    squares, turned = (centers**2).sum(1)[None], -2 * centers.T
    for i in range(0, len(points), 4096):
        near = points[i : i + 4096] @ turned
        near += squares
        out[i : i + 4096] = near.argmin(1)
    return out


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8, start: np.ndarray | None = None) -> np.ndarray:
    centers = start if start is not None else points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(points, centers)
        n = np.bincount(near, minlength=len(centers))
        some = n > 0
        first = (np.cumsum(n) - n)[some]
        centers[some] = np.add.reduceat(points[np.argsort(near, kind="stable")], first, axis=0) / n[some, None]
    return centers


class Quantiser:
    """Coarse centroids and subspace codebooks."""

    def __init__(self, sample: np.ndarray, trials: np.ndarray, lists: int, cosine: float = COSINE, seed: int = 0):
        rng = np.random.default_rng(seed)
        sample, trials = sample.astype(np.float32), trials.astype(np.float32)
        self.dim = sample.shape[1]
        self.width = -(-self.dim // SUBSPACES)
        self.coarse = kmeans(sample, lists, rng)
        rest = self._split(sample - self.coarse[_nearest(sample, self.coarse)])
        self.books = [kmeans(np.ascontiguousarray(rest[:, s]), CODES, rng) for s in range(SUBSPACES)]
        self.reach = self._reach(sample, trials, float(np.sqrt(2 - 2 * cosine)))
        self._borders = None

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, SUBSPACES * self.width - self.dim))).reshape(len(x), SUBSPACES, self.width)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, quantisation error) of unit vectors in their lists."""
        rest = self._split(x - self.coarse[home])
        codes = np.stack([_nearest(rest[:, s], self.books[s]) for s in range(SUBSPACES)], axis=1)
        left = rest - np.stack([self.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
        return codes.astype(np.uint8), np.sqrt((left**2).sum((1, 2)))

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        rest = np.concatenate([self.books[s][codes[:, s]] for s in range(SUBSPACES)], axis=1)
        return self.coarse[home] + rest[:, : self.dim]

    def _between(self, home: np.ndarray) -> np.ndarray:
        """Twice the distances of lists' centroids to every centroid."""
        squares = (self.coarse**2).sum(1)
        return 2 * np.sqrt(np.maximum(squares[home][:, None] + squares[None] - 2 * self.coarse[home] @ self.coarse.T, 0))

    def _reach(self, sample: np.ndarray, trials: np.ndarray, radius: float) -> float:
        """How far beyond its borders a vector looks, so that of two linked vectors one looks into the other's list in all but
        1 - COVERED of the trials.

        A trial goes from a vector that the centroids were not fitted on towards one of its nearest in the sample, as far as a
        linked vector can be, so it follows the directions that the data has, be they few or many. Never more than half the radius, at which no link
        can be missed (the border of two lists is a plane between the two vectors, so their distances to it sum up to at
        most the radius).
        """
        needs = []
        for i in range(0, len(trials), 256):
            x = trials[i : i + 256]
            like = x @ sample.T
            like[like > 1 - 1e-6] = -2  # nearly the vector itself: no direction
            near = np.argpartition(like, -min(NEIGHBOURS, len(sample) - 1), axis=1)[:, -NEIGHBOURS:]
            home = _nearest(x, self.coarse)
            for k in range(near.shape[1]):
                step = sample[near[:, k]] - x
                length = np.linalg.norm(step, axis=1, keepdims=True)
                y = x + radius * step / np.maximum(length, 1e-12)
                there = _nearest(y, self.coarse)
                rows = np.flatnonzero((there != home) & (length[:, 0] > 1e-4))
                a, b = self.coarse[home[rows]], self.coarse[there[rows]]
                # distances of both ends to the plane between the centroids
                plane = np.maximum(2 * np.linalg.norm(b - a, axis=1), 1e-12)
                ends = [(((v[rows] - far) ** 2).sum(1) - ((v[rows] - close) ** 2).sum(1)) / plane for v, close, far in ((x, a, b), (y, b, a))]
                need = np.zeros(len(x))
                need[rows] = np.minimum(*ends)
                needs.append(need)
        return float(min(radius / 2, 1.1 * np.quantile(np.concatenate(needs), COVERED))) if needs else radius / 2

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list of each unit vector, rows and lists of the probes, by rows; a vector's own list is among them)."""
        if self._borders is None and len(self.coarse) <= 1024:
            self._borders = self._between(np.arange(len(self.coarse)))
        away = x @ (-2 * self.coarse.T)
        away += (self.coarse**2).sum(1)[None]
        home = away.argmin(1)
        own = np.arange(len(x))
        away -= away[own, home][:, None]
        near = away <= self.reach * (self._borders[home] if self._borders is not None else self._between(home))
        near[own, home] = True
        return home, *np.nonzero(near)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length, from their bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 1), dtype=kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


class Cells:
    """How lists are dealt to tasks: neighbouring lists form a group, a group's vectors and its queries are cut into parts by
    the sample's numbers, and each two parts meet in a cell. The numbers decide about the sizes only."""

    def __init__(self, quantiser: Quantiser, sample: np.ndarray, count: int):
        most = max(1, min(count / GROUPS, max(BLOCK, BASE_BYTES // (4 * quantiser.dim))))
        scale = count / len(sample)
        homes, probes, rows = [], [], []
        step = max(1, min(2048, (1 << 22) // len(quantiser.coarse)))
        for i in range(0, len(sample), step):
            home, x, y = quantiser.place(sample[i : i + step].astype(np.float32))
            homes.append(home)
            rows.append(x + i)
            probes.append(y)
        weight = scale * np.bincount(np.concatenate(homes), minlength=len(quantiser.coarse))
        self.group = np.empty(len(weight), dtype=np.int64)
        todo, n = [np.arange(len(weight))], 0
        while todo:
            lists = todo.pop()
            if len(lists) > 1 and weight[lists].sum() > most:
                lists = lists[np.argsort(self._spread(quantiser.coarse[lists]), kind="stable")]
                sums = np.cumsum(weight[lists])
                cut = min(max(1, int(np.searchsorted(sums, sums[-1] / 2))), len(lists) - 1)
                todo += [lists[:cut], lists[cut:]]
            else:
                self.group[lists] = n
                n += 1
        asked = np.unique(np.concatenate(rows) * n + self.group[np.concatenate(probes)]) % n
        part = max(most, BLOCK)
        self.bases = np.maximum(1, np.ceil(np.bincount(self.group, weight, n) / part)).astype(np.int64)
        self.asks = np.maximum(1, np.ceil(scale * np.bincount(asked, minlength=n) / (4 * part))).astype(np.int64)
        sizes = self.bases * self.asks
        self.first, self.count = np.cumsum(sizes) - sizes, int(sizes.sum())

    @staticmethod
    def _spread(points: np.ndarray) -> np.ndarray:
        """Points along the direction of their largest spread."""
        points = points - points.mean(0)
        along = points[int((points**2).sum(1).argmax())]
        for _ in range(8):
            along = points.T @ (points @ along)
            along /= max(float(np.linalg.norm(along)), 1e-30)
        return points @ along


def _mixed(nodes: np.ndarray) -> np.ndarray:
    return ((nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


#: Rows of a cell hold many vectors: kind 0 are vectors of its lists with their codes and all their probes, kind 1 are queries with
#: their probes among the cell's lists.
PACKED = "cell int, kind int, node binary, copies binary, home binary, vector binary, probed binary, probes binary, codes binary, error binary"


def _packed(batch: pa.RecordBatch, quantiser: Quantiser, cells: Cells, kind: str) -> pa.RecordBatch:
    node, copies, vectors = batch["node"].to_numpy(), batch["copies"].to_numpy(), _matrix(batch["vector"], kind)
    step = max(1, min(2048, (1 << 22) // len(quantiser.coarse)))
    parts = []
    for i in range(0, len(node), step):
        x = unit(vectors[i : i + step]).astype(np.float32)
        home, row, probe = quantiser.place(x)
        parts.append((home, row + i, probe, *quantiser.encode(x, home)))
    home, row, probe, codes, error = (np.concatenate(c) for c in zip(*parts))
    home, probe, salt = home.astype(np.int32), probe.astype(np.int32), _mixed(node)
    probed = np.bincount(row, minlength=len(node)).astype(np.int32)
    starts = np.cumsum(probed, dtype=np.int64) - probed
    out: list[list] = [[] for _ in PACKED.split(",")]

    def put(cell: int, at: np.ndarray, probed: np.ndarray, probes: np.ndarray, base: bool) -> None:
        blobs = (node[at], copies[at], home[at], vectors[at], probed, probes, *((codes[at], error[at].astype(np.float64)) if base else ()))
        for column, value in zip(out, (cell, int(not base), *(b.tobytes() for b in blobs), *(() if base else (None, None)))):
            column.append(value)

    def runs(keys: np.ndarray):
        """(key, where it stands) of each key."""
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
        yield from zip(keys[order][cuts].tolist(), np.split(order, cuts[1:]) if len(cuts) else ())

    group = cells.group[home]
    for key, at in runs(cells.first[group] + salt % cells.bases[group] * cells.asks[group]):
        number = probed[at]
        every = np.repeat(starts[at] - (np.cumsum(number, dtype=np.int64) - number), number) + np.arange(number.sum())
        for q in range(int(cells.asks[group[at[0]]])):
            put(key + q, at, number, probe[every], True)
    group = cells.group[probe]
    for key, at in runs(cells.first[group] + salt[row] % cells.asks[group]):
        own, number = np.unique(row[at], return_counts=True)  # at ascends, and rows with it
        for b in range(int(cells.bases[group[at[0]]])):
            put(key + b * int(cells.asks[group[at[0]]]), own, number.astype(np.int32), probe[at], False)
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
    names = [c.split()[0] for c in PACKED.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)


class _Cell:
    """One cell: vectors by list, then queries in blocks; links are counted on both sides and once each."""

    def __init__(self, quantiser: Quantiser, cosine: float, kind: str):
        self.quantiser, self.cosine, self.kind = quantiser, cosine, kind
        self.base, self.asked, self.waiting, self.found = [], [], 0, []
        self.ready = False

    def _arrays(self, rows: list[dict]) -> list[np.ndarray]:
        kinds = {"node": np.int64, "copies": np.int64, "home": np.int32, "vector": self.kind, "probed": np.int32, "probes": np.int32}
        node, copies, home, vector, probed, probes = (np.concatenate([np.frombuffer(r[c], k) for r in rows]) for c, k in kinds.items())
        return [node, copies, home, unit(vector.reshape(len(node), -1)), probed, probes]

    def add(self, row: dict) -> None:
        if row["kind"] == 0:
            self.base.append(row)
            return
        self.asked.append(row)
        self.waiting += len(row["vector"])
        if self.waiting >= ASKED_BYTES:
            self._search()

    def _build(self) -> None:
        node, copies, home, x, probed, probes = self._arrays(self.base)
        codes = np.concatenate([np.frombuffer(r["codes"], np.uint8) for r in self.base]).reshape(len(node), -1)
        error = np.concatenate([np.frombuffer(r["error"], np.float64) for r in self.base])
        lists = len(self.quantiser.coarse)
        order = np.argsort(home, kind="stable")
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        self.probes = np.sort(np.repeat(back, probed) * lists + probes)
        self.node, self.copies, self.home, self.x = node[order], copies[order], home[order], x[order]
        self.coded = self.quantiser.decode(self.home, codes[order])
        # a code's squared distance to a unit vector is 1 + its square - 2 times their product
        far = np.sqrt(2 - 2 * self.cosine) + error[order] + 1e-3
        self.least = ((1 + (self.coded.astype(np.float64) ** 2).sum(1) - far**2) / 2).astype(np.float32)
        self.counts = np.zeros(len(node), dtype=np.int64)
        self.base, self.ready = [], True

    def _search(self) -> None:
        rows, self.asked, self.waiting = self.asked, [], 0
        if not self.ready:
            if not self.base:
                return
            self._build()
        node, copies, home, x, probed, probes = self._arrays(rows)
        single = x.astype(np.float32)
        query = np.repeat(np.arange(len(node)), probed)
        order = np.argsort(probes, kind="stable")
        cuts = np.flatnonzero(np.diff(probes[order], prepend=-1))
        counts, pairs = np.zeros(len(node), dtype=np.int64), []
        for own, at in zip(probes[order][cuts], np.split(query[order], cuts[1:])):
            a, b = np.searchsorted(self.home, [own, own + 1])
            for low in range(a, b, BASE):
                high = min(b, low + BASE)
                for i in range(0, len(at), ROWS):
                    some = at[i : i + ROWS]
                    close = np.flatnonzero(single[some] @ self.coded[low:high].T >= self.least[low:high])
                    if not len(close):
                        continue
                    p, q = np.divmod(close, high - low)
                    if len(close) * 50 > len(some) * (high - low):
                        sure = (x[some] @ self.x[low:high].T).ravel()[close] >= self.cosine
                    else:
                        sure = np.concatenate(
                            [np.einsum("ij,ij->i", x[some[p[k : k + 65536]]], self.x[low + q[k : k + 65536]]) >= self.cosine for k in range(0, len(p), 65536)]
                        )
                    p, q = some[p[sure]], low + q[sure]
                    # of a pair in one list: from the lower node; of one that looks both ways: in the lower list
                    key = q * len(self.quantiser.coarse) + home[p]
                    slot = np.minimum(np.searchsorted(self.probes, key), len(self.probes) - 1)
                    once = np.where(home[p] == own, node[p] < self.node[q], (own < home[p]) | (self.probes[slot] != key))
                    p, q = p[once], q[once]
                    counts += np.bincount(p, self.copies[q], minlength=len(counts)).astype(np.int64)
                    self.counts += np.bincount(q, copies[p], minlength=len(self.counts)).astype(np.int64)
                    pairs.append(star_labels(node[p], self.node[q]))
        self.found.append(_found(node[counts > 0], counts[counts > 0], None, None))
        if pairs:
            nodes, low = star_labels(*(np.concatenate(c) for c in zip(*pairs)))
            self.found.append(_found(None, None, nodes[nodes != low], low[nodes != low]))

    def done(self) -> list[pa.RecordBatch]:
        if self.asked:
            self._search()
        if self.ready:
            self.found.append(_found(self.node[self.counts > 0], self.counts[self.counts > 0], None, None))
        return self.found


LINKS = "node long, n long, u long, v long"


def _found(node, n, u, v) -> pa.RecordBatch:
    size = len(node if node is not None else u)
    pick = lambda c: pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64())
    return pa.RecordBatch.from_arrays([pick(c) for c in (node, n, u, v)], names=["node", "n", "u", "v"])


def _dimension(spark: SparkSession, nodes: DataFrame, count: int, cosine: float, kind: str) -> DataFrame:
    """(node, n, u, v): copies linked by node (n, else null; to be summed up) and edges, of distinct vectors of one length."""
    lists = int(min(MOST_TRAIN // PER_LIST, max(1, round(np.sqrt(count)))))
    drawn = nodes.select("node", "vector").where(share_of(F.col("node")) < (max(TRAIN_ROWS, PER_LIST * lists) + TRIALS) / count)
    sample = unit(_matrix(drawn.toArrow().sort_by("node")["vector"], kind))
    sample = sample[np.random.default_rng(1).permutation(len(sample))]
    trials, sample = np.split(sample, [min(TRIALS, len(sample) // 5)])
    quantiser = Quantiser(sample, trials, lists, cosine)
    cells = Cells(quantiser, trials, count)
    rows = max(1, PACKED_BYTES // (quantiser.dim * np.dtype(kind).itemsize))

    def index(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                yield _packed(batch.slice(i, rows), quantiser, cells, kind)

    def search(batches):
        cell, last = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch[name][i] for name in batch.schema.names}
                row = {name: v.as_py() if name in ("cell", "kind") else v.as_buffer() for name, v in row.items()}
                if row["cell"] != last:
                    if cell is not None:
                        yield from cell.done()
                    cell, last = _Cell(quantiser, cosine, kind), row["cell"]
                cell.add(row)
        if cell is not None:
            yield from cell.done()

    packed = nodes.select("node", "copies", "vector").mapInArrow(index, PACKED)
    dealt = packed.repartitionById(min(cells.count, MOST_TASKS), F.col("cell") % MOST_TASKS).sortWithinPartitions("cell", "kind")
    return materialise(spark, dealt.mapInArrow(search, LINKS), "links")


def _few(spark: SparkSession, nodes: DataFrame, cosine: float, kind: str) -> DataFrame:
    """_dimension() of vectors of rare lengths: those of a length are one list, in which every pair is compared."""

    def search(table: pa.Table) -> pa.Table:
        node, copies, x = table["node"].to_numpy(), table["copies"].to_numpy(), unit(_matrix(table["vector"], kind))
        linked, held = np.zeros(len(node), dtype=np.int64), []
        for i in range(0, len(node), 512):
            p, q = np.nonzero(x[i : i + 512] @ x.T >= cosine)
            p, q = p[p + i != q] + i, q[p + i != q]
            linked += np.bincount(p, copies[q], minlength=len(node)).astype(np.int64)
            held.append(star_labels(node[p], node[q]))
        nodes, low = star_labels(*(np.concatenate(c) for c in zip(*held)))
        return pa.Table.from_batches([_found(node[linked > 0], linked[linked > 0], None, None), _found(None, None, nodes[nodes != low], low[nodes != low])])

    rows = nodes.select("node", "copies", "vector", F.length("vector").alias("d"))
    return materialise(spark, rows.groupBy("d").applyInArrow(search, LINKS), "links")


def _as_bytes(batches):
    """(vec_id, bytes of the vector, or null if it links with nothing)."""
    for batch in batches:
        column = batch.column(1)
        ends = column.offsets.to_numpy().astype(np.int64)
        values = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False) + 0.0  # null: nan; -0: 0
        ends -= ends[0]
        number = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[ends])
        good = column.is_valid().to_numpy(zero_copy_only=False) & (number(~np.isfinite(values)) == 0) & (number(values != 0) > 0)
        offsets = (ends * values.itemsize).astype(np.int32)
        bits = pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
        packed = pa.Array.from_buffers(pa.binary(), len(good), [bits, pa.py_buffer(offsets), pa.py_buffer(values)])
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["vec_id", "vector"])


def near_duplicates(
    spark: SparkSession, table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
    lengths don't link. Repeated ids give a row each; a null id is a component's id only if no member has one (kept
    is then null). Equal vectors are linked with each other. An empty table gives none; other columns are ignored.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    kind = "float32" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "float64"
    if kind == "float64":
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    # equal vectors have equal bytes; a number of its own for each, fixed by the writing; rows find it again by 128 bits
    keys = {f"k{seed}": F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(seed), "vector")) for seed in (1, 2)}
    rows = materialise(spark, rows.mapInArrow(_as_bytes, "vec_id long, vector binary").withColumns(keys), "rows")
    nodes = rows.where("vector is not null").groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumns(keys)
    nodes = materialise(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    sizes = nodes.groupBy(F.length("vector").alias("d")).count()
    lengths = {r["d"]: r["count"] for r in sizes.where(F.col("count") > BLOCK).collect()}  # the frequent ones have a quantiser each
    labels = nodes.select("node", "k1", "k2", "copies", "least").withColumn("linked", F.lit(0).cast("long")).withColumn("root", F.col("node"))
    found = None
    rare = nodes.where(~F.length("vector").isin(*lengths)) if lengths else nodes
    if not rare.isEmpty():
        found = _few(spark, rare, cosine, kind)
    for d, count in sorted(lengths.items()):
        own = _dimension(spark, nodes.where(F.length("vector") == d), count, cosine, kind)
        found = own if found is None else found.unionByName(own)
    if found is not None:
        counts = found.where("n is not null").groupBy("node").agg(F.sum("n").alias("linked"))
        roots = connected_components(spark, found.where("u is not null").select("u", "v"), at_once=AT_ONCE)
        labels = nodes.select("node", "k1", "k2", "copies", "least").join(counts, "node", "left").join(roots, "node", "left")
        labels = labels.withColumn("root", F.coalesce("root", "node"))
    labels = labels.where("copies > 1 or linked > 0")  # others are their own component
    least = materialise(spark, labels.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labels = labels.join(least, "root").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    labels = materialise(spark, labels, "labels")
    out = rows.select("vec_id", "k1", "k2").join(labels, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))

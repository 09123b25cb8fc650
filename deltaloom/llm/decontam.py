"""Benchmark decontamination: documents that hold a passage within a small edit distance of a benchmark item.

Words are the symbols. For each item-sized window the random walk of Chakraborty, Goldenberg and Koucky (CGK) maps
edit distance to Hamming distance: at step t the walk writes the current word and advances by a random bit that
depends on t and the word. Bit-sampling LSH over the walks proposes (window, item) pairs; enough independent
walks and samples are drawn to reach the target recall. Each proposal is verified by exact edit distance.

Windows that cannot match are not embedded: an item of n words within k edits of a passage shares at least
n - q + 1 - k q of its q-grams with it (q = 3, 2 or, for items of a word, 1), which loses nothing. Items too short for any
edit are thereby found where they stand word for word. In scripts without spaces each character is a word.

Items are written to the shared folder in blocks; a worker loads the block that it looks for, the driver none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import file_system, fresh_path, materialise, worker_cache

SIMILARITY = 0.8
WALKS, SAMPLES, BITS = 12, 4, 2
GRAMS = (1, 2, 3)
#: Items that one pass over the documents looks for; more items take more passes.
BLOCK_ITEMS = 20_000
#: Cells of the largest arrays that a worker makes at once.
CELLS = 1 << 21
_WORD = re.compile(r"[^\W_]+")
#: Thai to Tibetan, Burmese, Khmer, kana, Han: scripts whose words are not parted by spaces.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_ANY_WORD = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; single characters in scripts without spaces."""
    text = (text or "").lower()
    return (_WORD if text.isascii() or not _HAS_UNSPACED.search(text) else _ANY_WORD).findall(text)


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Index:
    """What workers know of a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, seed: int = 7):
        texts = [(i, words(t)) for i, t in items]
        self.items = [(i, w) for i, w in texts if w]
        self.vocabulary = {w: n + 1 for n, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], dtype=np.int64) for _, ws in self.items]
        self.length = np.array([len(x) for x in self.ids], dtype=np.int64)
        self.edits = np.array([edits_allowed(int(n), similarity) for n in self.length], dtype=np.int64)
        self.gram = np.where(self.length - 2 - 3 * self.edits >= 1, 3, np.where(self.length > 1, 2, 1))
        self.need = np.maximum(1, self.length - self.gram + 1 - self.edits * self.gram)
        self.seed = seed
        self.base = len(self.vocabulary) + 1
        self.grams = {}
        for q in GRAMS:
            found = [(g, k) for k, x in enumerate(self.ids) if self.gram[k] == q for g in set(self._grams(x, q).tolist())]
            found.sort()
            self.grams[q] = (np.array([g for g, _ in found], dtype=np.int64), np.array([k for _, k in found], dtype=np.int64))
        rng = np.random.default_rng(seed)
        self.places = rng.random((WALKS, SAMPLES, BITS))  # as shares of three times the item's length
        hashed = np.zeros((len(self.ids), WALKS * SAMPLES), dtype=np.uint64)
        for rows in self._slices(self.length):
            hashed[rows] = self.hashes(self._padded([self.ids[k] for k in rows]), self.length[rows])
        self.tables = []
        for j in range(hashed.shape[1]):
            order = np.argsort(hashed[:, j], kind="stable")
            self.tables.append((hashed[order, j], order))

    @staticmethod
    def _slices(lengths: np.ndarray):
        """Row numbers in runs of similar length, so that a padded array of a run has at most CELLS cells (or one row)."""
        order = np.argsort(lengths, kind="stable")
        start = 0
        while start < len(order):
            stop = min(len(order), start + max(1, CELLS // max(1, int(lengths[order[start]]))))
            while stop - start > 1 and (stop - start) * int(lengths[order[stop - 1]]) > CELLS:
                stop = start + max(1, (stop - start) // 2)
            yield order[start:stop]
            start = stop

    @staticmethod
    def _padded(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=np.int64)
        for r, own in enumerate(rows):
            out[r, : len(own)] = own
        return out

    def _grams(self, ids: np.ndarray, q: int) -> np.ndarray:
        """Keys of the q-grams; -1 where a word is in no item."""
        n = len(ids) - q + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        key, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for j in range(q):
            key = key * self.base + ids[j : j + n]
            known &= ids[j : j + n] > 0
        return np.where(known, key, -1)

    def hashes(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(windows, WALKS * SAMPLES) LSH keys of windows (0-padded word ids) of the given lengths."""
        n, width = windows.shape
        out = np.zeros((n, WALKS * SAMPLES), dtype=np.uint64)
        padded = np.concatenate([windows, np.zeros((n, 1), dtype=np.int64)], axis=1)
        rows = np.arange(n)
        for walk in range(WALKS):
            steps = 3 * int(lengths.max(initial=0))
            sampled = (self.places[walk][None] * (3 * lengths)[:, None, None]).astype(np.int64)  # (n, SAMPLES, BITS)
            at = np.zeros(n, dtype=np.int64)
            keys = np.broadcast_to(lengths.astype(np.uint64)[:, None], (n, SAMPLES)).copy()
            # (step, window, sample) once each, by step
            codes = np.sort((sampled * (n * SAMPLES) + np.arange(n * SAMPLES).reshape(n, SAMPLES, 1)).ravel())
            codes = codes[np.r_[True, codes[1:] != codes[:-1]][: len(codes)]]
            stops = np.searchsorted(codes, np.arange(steps + 1) * (n * SAMPLES))
            for t in range(steps):
                symbol = padded[rows, np.minimum(at, width)]
                symbol = np.where(at < lengths, symbol, 0)
                coin = _mix(symbol, self.seed + walk * 100_003 + t)
                if stops[t] < stops[t + 1]:
                    x, y = np.divmod(codes[stops[t] : stops[t + 1]] - t * (n * SAMPLES), SAMPLES)
                    keys[x, y] = _mix(keys[x, y] * np.uint64(31) + symbol[x].astype(np.uint64), t + 1)
                at += (coin >> np.uint64(17) & np.uint64(1)).astype(np.int64)
            out[:, walk * SAMPLES : (walk + 1) * SAMPLES] = keys
        return out

    def _hits(self, at: np.ndarray, lo: np.ndarray, n: np.ndarray, owners: np.ndarray):
        """(places, items) of a document's q-grams that items have too, in pieces of at most CELLS (or one place's)."""
        ends, start = np.cumsum(n), 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CELLS, "right")))
            m = n[start:stop]
            yield np.repeat(at[start:stop], m), owners[np.repeat(lo[start:stop], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            start = stop

    def windows(self, docs: list[np.ndarray]):
        """(document, item, starts) of the item-sized windows that share enough q-grams with the item."""
        for d, ids in enumerate(docs):
            for q in GRAMS:
                keys, owners = self.grams[q]
                if not len(keys) or len(ids) < q:
                    continue
                grams = self._grams(ids, q)
                at = np.flatnonzero(grams >= 0)
                lo, hi = np.searchsorted(keys, grams[at], "left"), np.searchsorted(keys, grams[at], "right")
                at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                if not len(at):
                    continue
                count = np.zeros(len(self.items), dtype=np.int64)
                for _, item in self._hits(at, lo, n, owners):
                    count += np.bincount(item, minlength=len(count))
                enough = np.flatnonzero((count >= self.need) & (self.gram == q))
                # as many items at once as have CELLS hits together
                groups = np.cumsum(count[enough]) // CELLS
                for g in np.unique(groups):
                    mine = np.zeros(len(count), dtype=bool)
                    mine[enough[groups == g]] = True
                    held = [(p[mine[i]], i[mine[i]]) for p, i in self._hits(at, lo, n, owners)]
                    place, item = (np.concatenate(c) for c in zip(*held))
                    order = np.lexsort((place, item))
                    place, item = place[order], item[order]
                    cuts = np.searchsorted(item, np.flatnonzero(mine))
                    for k, hits in zip(np.flatnonzero(mine).tolist(), np.split(place, cuts[1:])):
                        starts = self._starts(hits, k, q, len(ids))
                        if len(starts):
                            yield d, k, starts

    def _starts(self, hits: np.ndarray, k: int, q: int, size: int) -> np.ndarray:
        """Starts of the windows that hold enough of the sorted hits: each run of so many neighbours allows an interval of them."""
        need, span = int(self.need[k]), int(self.length[k] + self.edits[k]) - q
        low, high = np.maximum(hits[need - 1 :] - span, 0), np.minimum(hits[: len(hits) - need + 1], size - 1)
        fits = high >= low
        if not fits.any():
            return np.zeros(0, dtype=np.int64)
        low, high = low[fits], high[fits] + 1
        begin = np.maximum(low, np.r_[0, np.maximum.accumulate(high)[:-1]])
        n = np.maximum(high - begin, 0)
        return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())

    def candidates(self, docs: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(document, item) -> starts of windows that collide with the item in one of the samples."""
        out: dict[tuple[int, int], list[int]] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            if not held:
                return
            doc, item, start = (np.concatenate(c) for c in zip(*held))
            held.clear()
            for rows in self._slices(self.length[item]):
                d, s, n = doc[rows], start[rows], self.length[item[rows]]
                hashed = self.hashes(self._padded([docs[a][b : b + c] for a, b, c in zip(d, s, n)]), n)
                for j, (keys, owners) in enumerate(self.tables):
                    lo, hi = np.searchsorted(keys, hashed[:, j], "left"), np.searchsorted(keys, hashed[:, j], "right")
                    for r in np.flatnonzero(hi > lo):
                        for k in owners[lo[r] : hi[r]]:
                            out.setdefault((int(d[r]), int(k)), []).append(int(s[r]))

        size = 0
        for d, k, starts in self.windows(docs):
            for i in range(0, len(starts), CELLS):
                part = starts[i : i + CELLS]
                held.append((np.full(len(part), d), np.full(len(part), k), part))
                size += len(part)
                if size >= CELLS // 8:
                    flush()
                    size = 0
        flush()
        return out

    def matches(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """(document, item, edits, start, end) of each item found, at its closest, leftmost passage."""
        out = []
        for (d, k), starts in sorted(self.candidates(docs).items()):
            slack, best = int(self.edits[k]), None
            starts = sorted(set(starts))
            while starts:
                low = high = starts.pop(0)
                while starts and starts[0] <= high + int(self.length[k]):
                    high = starts.pop(0)
                low, high = max(0, low - slack), high + int(self.length[k]) + 2 * slack
                edits, a, b = best_match(self.ids[k].tolist(), docs[d][low:high].tolist())
                if edits <= slack and (best is None or edits < best[0]):
                    best = (edits, low + a, low + b)
            if best:
                out.append((d, k, *best))
        return out


def _scores(pattern: list[int], text: list[int], free_start: bool) -> list[int]:
    """Edit distance of the pattern to the best text passage that ends at each place (Myers' bit vectors)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        where[symbol] = where.get(symbol, 0) | 1 << i
    plus, minus, score, out = full, 0, m, [m]
    for symbol in text:
        eq = where.get(symbol, 0) if symbol else 0
        vertical = eq | minus
        horizontal = ((((eq & plus) + plus) ^ plus) | eq) & full
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += bool(up & high) - bool(down & high)
        up = (up << 1 | (not free_start)) & full
        down = down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        out.append(score)
    return out


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(edits, start, end) of the passage of text closest to the pattern; the first that ends, then the longest."""
    scores = _scores(pattern, text, True)
    edits = min(scores)
    end = scores.index(edits)
    back = _scores(pattern[::-1], text[:end][::-1], False)
    return edits, end - max(i for i, s in enumerate(back) if s == edits), end


def _loaded(path: str, similarity: float) -> Index:
    """The index of a block of items, from its folder."""
    cache, key = worker_cache("decontam"), (path, similarity)
    if key not in cache:
        import pyarrow.parquet as pq

        cache.clear()
        fs, root = file_system(path)
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(root)) if f.path.endswith(".parquet"))
        rows = sorted(r for f in files for r in zip(*(pq.read_table(f, filesystem=fs)[c].to_pylist() for c in ("item_id", "text"))))
        cache[key] = Index(rows, similarity)
    return cache[key]


def find_in_texts(path: str, similarity: float, texts: list[str | None]) -> list[tuple[int, int, int, float, int, int]]:
    """(row, item_id, edits, similarity, start, end) of the matches in some texts."""
    index = _loaded(path, similarity)
    known = index.vocabulary.get
    docs = [np.array([known(w, 0) for w in words(t)], dtype=np.int64) for t in texts]
    return [(d, index.items[k][0], e, 1 - e / int(index.length[k]), a, b) for d, k, e, a, b in index.matches(docs)]


def _blocks(spark: SparkSession, benchmark: DataFrame, block: int) -> list[str]:
    """Folders of the items (null texts and ids left out, repeated rows once), a block of a bounded size each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(spark, rows.where("item_id is not null and text is not null").distinct(), "items")
    parts = max(1, -(-rows.count() // block))
    path = fresh_path(spark, "blocks")
    rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).repartition("block").write.partitionBy("block").parquet(path)
    fs, root = file_system(path)
    return [f"{path}/block={b}" for b in range(parts) if fs.get_file_info(f"{root}/block={b}").type == pa.fs.FileType.Directory]


def find_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
    block: int = BLOCK_ITEMS,
) -> DataFrame:
    """doc_id, item_id, edits, similarity, start_word, end_word: a row for each document and item that it holds.

    An item counts as held if a passage of the document is within (1 - similarity) of the item's words, by edit
    distance over lower-cased words (letters and digits). Items of a few words, for which that is less than one edit, are
    found word for word; items without a word are not looked for. Documents with null or empty text hold nothing; repeated
    rows give their rows each, and so do items that repeat an item_id with another text. No row is shuffled. Other columns are
    ignored; without documents or items there are no rows.
    """
    schema = "doc_id long, item_id long, edits long, similarity double, start_word long, end_word long"
    found = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for path in _blocks(spark, benchmark, block):

        def run(batches, path=path):
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    hits = find_in_texts(path, similarity, part.column(1).to_pylist())
                    if hits:
                        d, item, edits, close, a, b = zip(*hits)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(d)), pa.array(item, pa.int64()), pa.array(edits, pa.int64()), pa.array(close, pa.float64()),
                             pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                            names=["doc_id", "item_id", "edits", "similarity", "start_word", "end_word"],
                        )

        own = rows.mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], schema) if found is None else found


def without_leaks(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", block: int = BLOCK_ITEMS
) -> DataFrame:
    """The rows of docs that hold no item (see find_leaks). Map-only, so it needs no id.

    Null and empty texts hold nothing and stay; repeated rows share their fate. Columns, of any name, and types are those of
    docs; an empty table stays empty, and without items all rows stay.
    """
    for path in _blocks(spark, benchmark, block):
        place = docs.columns.index(text_col)

        def run(batches, path=path, place=place):
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    keep = np.ones(part.num_rows, dtype=bool)
                    for hit in find_in_texts(path, similarity, part.column(place).to_pylist()):
                        keep[hit[0]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

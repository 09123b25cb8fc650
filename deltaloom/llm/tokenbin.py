"""Token ids as binary shards, with a minimal perfect hash index from document keys to places in them.

Shard file: 16-byte head (magic, version, bytes per id), then raw little-endian ids of the shard's documents in
ascending doc_id order (null first), nothing between them. Ids take two bytes if the vocabulary allows, else four.

Index: keys are dealt by hash into parts; each part is a file with a minimal perfect hash of its distinct keys, then
one slot for each key: 32-bit fingerprint, shard, byte offset, tokens, rows, whether the id is null. One key is found by a constant
number of small reads (IndexFile); many keys of a part share one read of its file. Offsets are relative to the shard's first id.

Both kinds of files are written under names of their own for each task attempt; only what the committed
manifest names is ever read, so lost or repeated tasks do no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import file_system, fresh_path, materialise, worker_cache

MAGIC, HEAD, INDEX_HEAD = b"DLTK", "<4sHH8x", "<4sIII"
HEAD_BYTES, INDEX_HEAD_BYTES = struct.calcsize(HEAD), struct.calcsize(INDEX_HEAD)
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("tokens", "<u8"), ("rows", "<u4"), ("null", "<u4")])
PART_KEYS = 50_000
#: Bytes of ids that a task reads back, about.
READ_BYTES = 32 << 20
#: Levels of a perfect hash beyond which keys can only be equal.
MOST_LEVELS = 128
#: White space as the pre-tokenizer's pattern has it. A piece is a run of other characters with a space before it, or
#: white space; no token of a byte-level BPE with that pattern reaches over the border of two pieces.
_WS = "\t-\r \x85\xa0  -     　"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECE = re.compile(f" ?[{_LETTERS}]+(?![^{_WS}.,!?;:])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Texts that are more than words with single spaces or line ends between them.
_ODD = "[WS][WS]|^[WS]|[WS]$|[\\t\\v\\f\\rWX\\x00\\x01]".replace("WS", _WS).replace("WX", _WS[4:])
_MARKS = frozenset(".,!?;:")
_CACHE_PIECES, _CACHE_WORDS = 50_000, 400_000
#: What a word of a text that is not odd starts with in place of a space: at a line's start, at the text's.
_STARTS = {"\x00": "\n", "\x01": ""}


_WORD = re.compile(f" ?[{_LETTERS}]+")


def _byte_letters() -> dict[int, int]:
    """Byte-level letters: printable bytes of Latin-1 stand for themselves, the others for 256 and up in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printable)}


class _Pieces(dict):
    """Raw ids of pieces, by the library where they are not known yet. One run of letters or digits goes straight to its model."""

    def __init__(self, tokenizer, dtype: np.dtype):
        self.tokenizer, self.dtype = tokenizer, dtype
        self.model, self.letters = tokenizer.model, _byte_letters()
        self.space, self.code = chr(self.letters[32]), "H" if dtype.itemsize == 2 else "I"

    def __missing__(self, piece: str) -> bytes:
        run = piece.removeprefix(" ")
        if run.isascii() and (run.isalpha() or run.isdigit()):
            found = self[piece] = self.run(piece.replace(" ", self.space))
            return found
        if _WORD.fullmatch(piece):
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        found = self[piece] = array(self.code, ids).tobytes()
        return found

    def run(self, run: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(run)]).tobytes()

    def word(self, word: str) -> bytes:
        """Raw ids of a space and a word, as whole() gives them; plain words, with a mark after them or not, need no search."""
        if word.isalpha() and word.isascii():
            return self.run(self.space + word)
        if word[-1:] in _MARKS and word.isascii() and word[:-1].isalpha():
            return self.run(self.space + word[:-1]) + self[word[-1]]
        if word[:1] in _STARTS:
            return self.whole(_STARTS[word[0]] + word[1:])
        return self.whole(" " + word)

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


class _Words:
    """Ids of the words met so far, in flat arrays: no object is kept for a word. Beyond the limit, words not met since the
    last time go, and all go if that isn't enough; they are encoded anew when they come again."""

    def __init__(self, pieces: _Pieces):
        self.pieces = pieces
        self.keep(pa.array([], pa.string()), np.zeros(0, pieces.dtype), np.zeros(0, np.int64))

    def keep(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.ids, self.sizes = words, ids, sizes
        self.begins = np.cumsum(sizes) - sizes
        self.met = np.zeros(len(words), dtype=bool)

    def shrink(self) -> None:
        stay = self.met if np.count_nonzero(self.met) < _CACHE_WORDS // 2 else np.zeros(len(self.met), dtype=bool)
        self.keep(self.words.filter(pa.array(stay)), self.ids[np.repeat(stay, self.sizes)], self.sizes[stay])

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of the distinct words is; those not met before are added."""
        if len(self.words) > _CACHE_WORDS:
            self.shrink()
        at, n = pc.index_in(words, value_set=self.words), len(self.words)
        new = words.filter(at.is_null())
        found = [self.pieces.word(w) for w in new.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.pieces.dtype.itemsize
        met = self.met
        self.keep(pa.concat_arrays([self.words, new]), np.r_[self.ids, np.frombuffer(b"".join(found), self.pieces.dtype)], np.r_[self.sizes, sizes])
        places = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        places[places < 0] = np.arange(n, n + len(new))
        self.met[:n] = met
        self.met[places] = True
        return places


def by_pieces(spec: dict) -> bool:
    """Whether a tokenizer's ids of a text are those of its pieces, one after the other: a byte-level BPE with the usual
    pattern, without a normaliser, dropout or marks of its own. Others get whole texts."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = all(not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    pattern = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    return spec.get("normalizer") is None and model.get("type") == "BPE" and plain and pattern and not spec.get("truncation")


def _tokenizer(path: str):
    """(tokenizer, special strings, dtype of ids, words), loaded once for each worker. Words are None if texts go in whole."""
    cache = worker_cache("tokenbin")
    if path not in cache:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        dtype = np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = by_pieces({k: v for k, v in spec.items() if k != "added_tokens"})
        cache[path] = (tokenizer, special, dtype, _Words(_Pieces(tokenizer, dtype)) if cut else None)
    return cache[path]


def _plain(texts: pa.Array, known: _Words) -> list[bytes]:
    """Raw ids of texts that are not odd: each distinct word of the batch is looked up once."""
    marked = pc.binary_join_element_wise("\x01", pc.replace_substring(texts, "\n", " \x00"), "")
    cut = pc.split_pattern(marked, " ")
    words = cut.flatten().dictionary_encode()
    codes = known.places(words.dictionary)[words.indices.to_numpy()]
    ids, sizes, begins, width = known.ids, known.sizes, known.begins, known.ids.dtype.itemsize
    bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    out = []
    for i in range(0, len(texts), 512):
        at = bounds[i : i + 513]
        own = codes[at[0] : at[-1]]
        lengths = sizes[own]
        ends = np.cumsum(lengths)
        raw = ids[np.arange(ends[-1]) + np.repeat(begins[own] - ends + lengths, lengths)].tobytes()
        stops = ends[at[1:] - at[0] - 1] * width
        out += [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
    return out


def encode(path: str, texts: pa.Array | list[str | None], end_id: int = 0) -> list[bytes]:
    """Raw ids of each whole text (null: empty), an end id appended.

    The library encodes each distinct piece once and the ids of a text are joined from its pieces, which is
    what it returns for the whole text; texts with an added token's string go through it whole, and all texts do where
    by_pieces() does not know the tokenizer's kind.
    """
    tokenizer, special, dtype, known = _tokenizer(path)
    end = np.array([end_id], dtype=dtype).tobytes()
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    if known is None:
        return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype=dtype).tobytes() + end for t in texts.to_pylist()]
    pieces = known.pieces
    if len(pieces) > _CACHE_PIECES:
        pieces.clear()
    odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(texts, ""))
    for s in special:
        odd = pc.or_(odd, pc.match_substring(texts, s))
    plain = pc.invert(odd)
    fast = iter(_plain(texts.filter(plain), known) if pc.any(plain).as_py() else [])
    slow = iter(texts.filter(odd).to_pylist())
    out = []
    for is_odd in odd.to_pylist():
        if not is_odd:
            out.append(next(fast) + end)
        elif any(s in (text := next(slow)) for s in special):
            out.append(np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=dtype).tobytes() + end)
        else:
            out.append(pieces.whole(text) + end)
    return out


def mix(key: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function (finaliser of splitmix64), seeded."""
    x = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_mph(keys: np.ndarray) -> np.ndarray:
    """A minimal perfect hash of distinct 64-bit keys, by levels of bit arrays.

    At each level the keys left hash into 1.5 times as many bits; a key alone on its bit sets it, the others go on to the
    next level; equal keys are an error. The slot of a key is the rank of its bit among all set bits, so a lookup takes a constant number of
    steps (two levels on average). Packed: levels, bits of each level, then for each 64-bit word its rank and the word.
    """
    sizes, words = [], []
    while len(keys):
        if len(sizes) == MOST_LEVELS:
            raise ValueError(f"{len(keys)} keys are not distinct")
        n = -(-len(keys) * 3 // 2 // 64) * 64 or 64
        at = (mix(keys, len(sizes)) % np.uint64(n)).astype(np.int64)
        alone = np.bincount(at, minlength=n) == 1
        sizes.append(n)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        keys = keys[~alone[at]]
    bits = np.concatenate([np.zeros(0, dtype="<u8"), *words])
    ranks = np.r_[0, np.cumsum(np.bitwise_count(bits), dtype=np.int64)][: len(bits)].astype("<u8")
    return np.concatenate([np.array([len(sizes), *sizes], dtype="<u8"), ranks, bits])


def find_slots(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The one slot that each key can be in; 0 for keys that no level has (their fingerprint tells)."""
    levels = int(packed[0])
    sizes = packed[1 : levels + 1].astype(np.int64)
    total = int(sizes.sum()) // 64
    ranks, bits = packed[levels + 1 : levels + 1 + total], packed[levels + 1 + total : levels + 1 + 2 * total]
    slots, left, base = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), 0
    for level, n in enumerate(sizes):
        at = (mix(keys[left], level) % np.uint64(n)).astype(np.int64)
        word, bit = base + at // 64, (at % 64).astype(np.uint64)
        hit = (bits[word] >> bit & np.uint64(1)).astype(bool)
        below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
        slots[left[hit]] = (ranks[word] + below)[hit].astype(np.int64)
        left, base = left[~hit], base + n // 64
    return slots


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 2) >> np.uint64(32)).astype(np.uint32)


def _key(column):
    """A 64-bit key of a doc_id. Null shares that of the least id, -2^63: their rows stand side by side, count as copies of one
    key, and are told apart by the slot's mark."""
    return F.coalesce(column, F.lit(-(1 << 63)))


def _copy_keys(keys: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Keys of the rows that repeat a key: the first keeps its own."""
    return np.where(copies == 0, keys, mix(keys ^ (copies.astype(np.uint64) << np.uint64(32)), 3))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Writes every text's ids; returns the folder and the manifest: shard, file, id_bytes, doc_id, copy, offset, tokens.
    Rows that repeat an id stand side by side, in one shard; copy counts them from 0 (a null id and -2^63 together)."""
    folder = fresh_path(spark, "tokens")
    lowest = -(1 << 63)

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        name, out, offset = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids", None, 0
        dtype = _tokenizer(path)[2]
        last, copy = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(struct.pack(HEAD, MAGIC, 1, dtype.itemsize))
            lengths = []
            for i in range(0, batch.num_rows, 1024):
                found = encode(path, batch.column(1).slice(i, 1024), end_id)
                out.write(b"".join(found))
                lengths += [len(f) for f in found]
            ends = offset + np.cumsum(np.array(lengths, dtype=np.int64))
            n = batch.num_rows
            copies = np.zeros(n, dtype=np.int32)
            for i, doc in enumerate(pc.fill_null(batch.column(0), lowest).to_pylist()):
                copy = copy + 1 if copy >= 0 and doc == last else 0
                last, copies[i] = doc, copy
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard)), pa.array([name] * n), pa.array(np.full(n, dtype.itemsize, dtype=np.int32)), batch.column(0), pa.array(copies),
                    pa.array(np.r_[offset, ends[:-1]]), pa.array(np.array(lengths, dtype=np.int64) // dtype.itemsize),
                ],
                names=["shard", "file", "id_bytes", "doc_id", "copy", "offset", "tokens"],
            )
            offset = int(ends[-1])
            pa.default_memory_pool().release_unused()
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(_shards(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = rows.mapInArrow(run, "shard long, file string, id_bytes int, doc_id long, copy int, offset long, tokens long")
    return folder, materialise(spark, written, "manifest")


def _shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_index(spark: SparkSession, manifest: DataFrame) -> tuple[str, DataFrame]:
    """Writes the index files over a manifest; returns the folder and (part, parts, file). Each row has a slot,
    which also has the number of rows with its id."""
    folder = fresh_path(spark, "index")
    key = _key(F.col("doc_id")).alias("key")
    again = materialise(spark, manifest.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1"), "repeated")
    keys = manifest.select(key, F.col("doc_id").isNull().cast("int").alias("null"), "copy", "shard", "offset", "tokens").join(again, "key", "left")
    keys = keys.withColumn("rows", F.coalesce("rows", F.lit(1)).cast("long"))
    parts = max(1, -(-manifest.count() // PART_KEYS))
    keys = keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("long"))

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            table = pa.Table.from_batches(held)
            fs, root = file_system(folder)
            fs.create_dir(root, recursive=True)
            name = f"part-{table['part'][0].as_py():06d}-{uuid.uuid4().hex}.mph"
            own = _copy_keys(table["key"].to_numpy().view(np.uint64), table["copy"].to_numpy())
            packed = build_mph(own)
            place = find_slots(packed, own)
            slots = np.zeros(len(own), dtype=SLOT)
            for field in ("shard", "offset", "tokens", "rows", "null"):
                slots[field][place] = table[field].to_numpy()
            slots["print"][place] = _print(own)
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(struct.pack(INDEX_HEAD, MAGIC, 1, len(packed), len(slots)) + packed.tobytes() + slots.tobytes())
            return pa.RecordBatch.from_arrays([table["part"].slice(0, 1).combine_chunks(), pa.array([name])], names=["part", "file"])

        for batch in batches:
            while batch.num_rows:
                first = batch["part"][0].as_py()
                if held and held[0]["part"][0].as_py() != first:
                    yield flush()
                    held = []
                run_length = int(np.searchsorted(batch["part"].to_numpy(), first, side="right"))
                held.append(batch.slice(0, run_length))
                batch = batch.slice(run_length)
        if held:
            yield flush()

    files = keys.repartition("part").sortWithinPartitions("part", "key", "copy").mapInArrow(run, "part long, file string")
    return folder, materialise(spark, files.withColumn("parts", F.lit(parts)), "index")


class IndexFile:
    """One part's file, open: a key is found by a few small reads, whose number does not depend on the number of keys.

    find() reads the head once, then a rank and a word of bits for each level that the key passes (two on average) and one slot.
    """

    def __init__(self, source):
        self.source = source
        _, _, self.n_words, self.n_slots = struct.unpack(INDEX_HEAD, self._read(0, INDEX_HEAD_BYTES))
        levels = int(np.frombuffer(self._read(INDEX_HEAD_BYTES, 8), "<u8")[0])
        self.sizes = np.frombuffer(self._read(INDEX_HEAD_BYTES + 8, 8 * levels), "<u8").astype(np.int64)
        self.ranks_at = INDEX_HEAD_BYTES + 8 * (1 + levels)
        self.bits_at = self.ranks_at + int(self.sizes.sum()) // 8

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def find(self, doc_id: int | None, copy: int = 0):
        """The slot of a document's row, or None if the part has none with its fingerprint."""
        own = np.array([-(1 << 63) if doc_id is None else doc_id], dtype=np.int64).view(np.uint64)
        own = _copy_keys(own, np.array([copy]))
        base = 0
        for level, n in enumerate(self.sizes):
            at = int(mix(own, level)[0] % np.uint64(n))
            word, bit = base + at // 64, at % 64
            bits = int.from_bytes(self._read(self.bits_at + 8 * word, 8), "little")
            if bits >> bit & 1:
                rank = int.from_bytes(self._read(self.ranks_at + 8 * word, 8), "little") + (bits & (1 << bit) - 1).bit_count()
                slot = np.frombuffer(self._read(INDEX_HEAD_BYTES + 8 * self.n_words + SLOT.itemsize * rank, SLOT.itemsize), SLOT)[0]
                same = slot["print"] == _print(own)[0] and bool(slot["null"]) == (doc_id is None)
                return slot if same else None
            base += n // 64
        return None


def part_of(doc_id: int | None, parts: int) -> int:
    """The part of a doc_id, as write_index() deals it."""
    from xxhash import xxh64_intdigest

    key = -(1 << 63) if doc_id is None else doc_id
    h = xxh64_intdigest(struct.pack("<q", key), 42)
    return (h - (1 << 64) if h >> 63 else h) % parts


def read_ids(folder: str, file: str, id_bytes: int, offset: int, tokens: int) -> np.ndarray:
    """The ids of one document, by one seek into its shard."""
    fs, root = file_system(folder)
    with fs.open_input_file(f"{root}/{file}") as source:
        source.seek(HEAD_BYTES + offset)
        return np.frombuffer(source.read(tokens * id_bytes), f"<u{id_bytes}")


def _copies_of(keys: np.ndarray, asked: np.ndarray, found: np.ndarray):
    """(place in asked, copy) of all rows beyond the first of keys that have more, in blocks of a bounded size."""
    more = found["rows"].astype(np.int64) - 1
    ends = np.cumsum(more)
    for start in range(0, int(ends[-1]) if len(ends) else 0, 1 << 20):
        at = np.arange(start, min(start + (1 << 20), int(ends[-1])))
        owner = np.searchsorted(ends, at, side="right")
        yield asked[owner], keys[owner], at - (ends[owner] - more[owner]) + 1


def lookup(spark: SparkSession, keys: DataFrame, index_folder: str, index: DataFrame) -> DataFrame:
    """doc_id, shard, offset, tokens of all rows of the keys (column doc_id) that the index has; each part's file is read once
    for each run of its keys. Keys that no document has are told by their fingerprint (but for one in 2**32)."""
    first = index.first()
    if first is None:
        return spark.createDataFrame([], "doc_id long, shard long, offset long, tokens long")
    asked = keys.select("doc_id").distinct().withColumn("key", _key(F.col("doc_id")))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(first["parts"])).cast("long")).join(index.select("part", "file"), "part")

    def run(batches):
        fs, root = file_system(index_folder)
        name, packed, slots = None, None, None
        for batch in batches:
            files = batch.column(2).to_pylist()
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)

            def rows(ids, found):
                own = (found["null"] == 1) == null[ids]
                ids, found = ids[own], found[own]
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(ids)), *[pa.array(found[c].astype(np.int64)) for c in ("shard", "offset", "tokens")]],
                    names=["doc_id", "shard", "offset", "tokens"],
                )

            start = 0
            while start < len(files):
                stop = start
                while stop < len(files) and files[stop] == files[start]:
                    stop += 1
                if files[start] != name:
                    name = files[start]
                    with fs.open_input_file(f"{root}/{name}") as f:
                        raw = f.read()
                    _, _, n_words, n_slots = struct.unpack_from(INDEX_HEAD, raw)
                    packed = np.frombuffer(raw, "<u8", n_words, INDEX_HEAD_BYTES)
                    slots = np.frombuffer(raw, SLOT, n_slots, INDEX_HEAD_BYTES + 8 * n_words)
                own = batch.column(1).to_numpy()[start:stop].view(np.uint64)
                ids = np.arange(start, stop)
                found = slots[find_slots(packed, own)]
                known = found["print"] == _print(own)
                ids, own, found = ids[known], own[known], found[known]
                yield rows(ids, found)
                for again, key, copies in _copies_of(own, ids, found):
                    yield rows(again, slots[find_slots(packed, _copy_keys(key, copies))])
                start = stop

    dealt = asked.select("doc_id", "key", "file").repartition(max(1, first["parts"]), "file").sortWithinPartitions("file", "key")
    return dealt.mapInArrow(run, "doc_id long, shard long, offset long, tokens long")


def read_back(spark: SparkSession, places: DataFrame, folder: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document at the places (from lookup), read from the shard files.

    shards: shard, file, id_bytes, base (ids in the shards before), tokens, a row for each shard.
    """
    placed = places.join(shards.drop("tokens"), "shard").select("file", "id_bytes", "base", "doc_id", "offset", "tokens")

    def run(batches):
        fs, root = file_system(folder)
        name, source = None, None
        for batch in batches:
            out: list[tuple] = []
            for file, width, base, doc, offset, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                source.seek(HEAD_BYTES + offset)
                ids = np.frombuffer(source.read(tokens * width), f"<u{width}")
                out.append((doc, base + offset // width, tokens, zlib.crc32(ids.astype("<u4").tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # by bytes to read, not by the size of these rows
    total = shards.agg(F.sum(F.col("tokens") * F.col("id_bytes"))).first()[0] or 0
    parts = max(1, -(-total // READ_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.repartition(parts, F.col("file"), F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_table(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """shard, file, id_bytes, base, tokens. A row for each shard: the driver sums up their sizes (as many as partitions)."""
    sizes = manifest.groupBy("shard", "file", "id_bytes").agg(F.sum("tokens").alias("n")).orderBy("shard").collect()
    base, rows = 0, []
    for r in sizes:
        rows.append((r["shard"], r["file"], r["id_bytes"], base, r["n"]))
        base += r["n"]
    return spark.createDataFrame(rows, "shard long, file string, id_bytes int, base long, tokens long")


def digest(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, written, looked up by key and read back.

    Null texts count as empty (the end id alone). A null doc_id comes first and has a key of its own. Rows that repeat a
    doc_id are ordered by text. An empty table gives none. Other columns are ignored.
    """
    folder, manifest = write_shards(spark, docs, tokenizer, end_id, id_col, text_col)
    index_folder, index = write_index(spark, manifest)
    places = lookup(spark, docs.select(F.col(id_col).cast("long").alias("doc_id")), index_folder, index)
    return read_back(spark, places, folder, shard_table(spark, manifest))

"""Language-model scoring: a trigram model with Katz backoff over Good-Turing discounted counts.

P3(w | u v) = cut(c(uvw)) / c(uv) where the trigram was seen, else alpha(uv) P2(w | v); P2(w | v) = cut(c(vw)) / c(v) where
the pair was seen, else alpha(v) P1(w); P1 is the add-0.1 unigram estimate that also serves as base score. cut(c) = d_c c
by Good and Turing for counts up to K, c beyond. alpha normalises exactly: (1 - seen mass) / (1 - lower-order mass of the
words seen). A context whose counts are all beyond K has nothing cut off and counts once more, so that it keeps some mass.

Documents are packed by chunk into buckets: the tokens whose last history word v falls into the bucket, as distinct
(v, u, w) with the documents that hold them. All of an order's sums over a context lie in one bucket then. A bucket's
trigrams are counted once and stored (kind model, see ngrams()): counts of pairs and contexts follow from them. Tokens whose
trigram was seen are settled there; the others are evaluated against the stored table, order by order, when the
discounts and the unigram counts that a bucket asks for are known. Frequent words v (found in a bounded sample; a choice of
placement only) are spread over the buckets by u, and their pairs are counted where the counts of w are.

Tables in the shared folder, partitioned by kind: docs, sums, model, stats; answers, stats, hot; answers by bucket; rest.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import file_system, fresh_path, trim

#: Bytes of text in a chunk and in a bucket, about; a longer text is a chunk of its own. What a task holds grows with
#: them, and packets (chunks x buckets, empty ones aside) shrink: larger executors should have larger ones.
CHUNK_BYTES, BUCKET_BYTES = 10 << 20, 12 << 20
K, SMOOTH, FOLDS = 5, 0.1, 10
#: Words spread over all buckets, and words that packets name by number, at most; texts of the sample that finds them, about.
HOT, COMMON, SAMPLE = 1000, 200_000, 6000
#: Bytes of rows that go from Python to Spark at once, about.
BATCH_BYTES = 1 << 19
#: Sums of logarithms are kept in whole steps of this size, so that they don't depend on an order and pack well.
STEP = 2.0**-30
END, START, WORD_SEED = 0, 1, 7
_TABLE = "kind string, part long, payload binary"


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), told apart by ASCII white space; the end is added by the callers."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % FOLDS == 0


def word_key(word: bytes) -> int:
    """64 bits of a word, 2 and up; 0 is the end, 1 the start."""
    from xxhash import xxh64_intdigest

    return max(2, xxh64_intdigest(word, WORD_SEED))


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays byte by byte in their narrowest unsigned type, compressed; floats as they are."""
    import zstandard

    slim = {}
    for k, a in arrays.items():
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        slim[k] = (a.dtype.str, a.shape, np.ascontiguousarray(a.reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(slim, protocol=5))


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    import zstandard

    found = pickle.loads(zstandard.ZstdDecompressor().decompress(raw))
    return {k: np.ascontiguousarray(a.T).reshape(-1).view(kind).reshape(shape) for k, (kind, shape, a) in found.items()}


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which pack better."""
    return np.diff(keys, prepend=np.zeros(1, dtype=np.uint64))


def _keys(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x ^ (y * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def _bucket(x: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    return (_mix(x, y) % np.uint64(buckets)).astype(np.int64)


def _rows(found: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, payloads = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(parts, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "part", "payload"])


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where, whether) keys are among sorted ones."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _runs(new: np.ndarray) -> np.ndarray:
    """Lengths of the runs that begin where ``new`` is true."""
    starts = np.flatnonzero(new)
    return np.diff(np.r_[starts, len(new)])


def _members(starts: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Numbers of the members of the groups ``mine``, whose members begin at ``starts``."""
    n = starts[mine + 1] - starts[mine]
    return np.repeat(starts[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())


class Plan:
    """What packers and counters share: buckets, frequent words (sorted keys) and words that have a number."""

    def __init__(self, buckets: int, hot: np.ndarray, common: np.ndarray):
        self.buckets, self.hot, self.common = buckets, hot, common


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order, by a sort: numpy's own way through a hash table takes longer."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _numbered(high: np.ndarray, n: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct high * n + low in order, and the number of each row's."""
    codes = high.astype(np.int64)
    codes *= n
    codes += low
    found, number = np.unique(codes, return_inverse=True)
    return found, number.astype(np.int32)


def pack_chunk(chunk: int, ids: list[int | None], texts: list[str | None], plan: Plan):
    """The rows of a chunk: kind docs (its documents and their frequent words) and kind grams by bucket."""
    from xxhash import xxh64_intdigest

    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    found, sizes = [], np.zeros(len(ids), dtype=np.int64)
    for d, text in enumerate(texts):
        words = tokens(text)
        sizes[d] = len(words) + 1
        found.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)) + np.int32(2))
    del texts
    keys = np.empty(len(number) + 2, dtype=np.uint64)
    keys[:2] = END, START
    keys[2:] = np.maximum(np.fromiter(map(xxh64_intdigest, number, repeat(WORD_SEED)), dtype=np.uint64, count=len(number)), 2)  # word_key()
    n = len(keys)
    number.clear()
    end, start = np.zeros(1, dtype=np.int32), np.ones(2, dtype=np.int32)
    w = np.concatenate([x for f in found for x in (f, end)])
    v = np.concatenate([x for f in found for x in (start[:1], f)])
    u = np.concatenate([x for f in found for x in (start[: len(f) + 1], f[:-1])])
    del found
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    # contexts (v, u), then trigrams (context, w), then their documents
    pairs, pair = _numbered(v, n, u)
    at, is_hot = _place(plan.hot, keys)
    hot_rows = is_hot[v] & (keys[v] != START)
    own, per = np.unique(doc[hot_rows].astype(np.int64) * len(plan.hot) + at[v[hot_rows]], return_counts=True)
    del u, v
    grams, gram = _numbered(pair, n, w)
    del pair, w
    cells = gram.astype(np.int64)
    cells *= len(ids)
    cells += doc
    del gram, doc
    cells, counts = np.unique(cells, return_counts=True)
    held = np.packbits(np.array([held_out(i) for i in ids], dtype=bool))
    yield "docs", chunk, _pack(
        doc_id=np.array([i or 0 for i in ids], dtype=np.int64).view(np.uint64), null=np.packbits([i is None for i in ids]), held=held,
        size=sizes, hot_doc=own // len(plan.hot), hot_word=own % len(plan.hot), hot_count=per,
    )
    cv, cu = pairs // n, pairs % n
    bucket = _bucket(keys[cv], np.where(is_hot[cv], keys[cu], 0).astype(np.uint64), plan.buckets)
    gram_ctx, gram_w = grams // n, grams % n
    cell_gram, cell_doc = cells // len(ids), cells % len(ids)
    ctx_grams = np.searchsorted(gram_ctx, np.arange(len(pairs) + 1))
    gram_cells = np.searchsorted(cell_gram, np.arange(len(grams) + 1))
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(plan.buckets + 1))
    common_at, is_common = _place(plan.common, keys)
    name = np.where(is_common, common_at, -1)
    used = np.zeros(n, dtype=bool)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        mine = order[cuts[b] : cuts[b + 1]]
        types = _members(ctx_grams, mine)
        rows = _members(gram_cells, types)
        for x in (cv[mine], cu[mine], gram_w[types]):
            used[x] = True
        rare = np.flatnonzero(used)
        used[rare] = False
        rare = rare[name[rare] < 0]
        rare = rare[np.argsort(keys[rare])]
        name[rare] = len(plan.common) + np.arange(len(rare))
        new_v = np.r_[True, cv[mine][1:] != cv[mine][:-1]]
        yield "grams", b, _pack(
            chunk=np.array([chunk]), words=_steps(keys[rare]), v=name[cv[mine][new_v]], v_run=_runs(new_v), u=name[cu[mine]],
            u_run=(ctx_grams[mine + 1] - ctx_grams[mine]), w=name[gram_w[types]], w_run=gram_cells[types + 1] - gram_cells[types],
            doc=cell_doc[rows], count=counts[rows] - 1, held=held, n=np.array([len(ids)]),
        )
        name[rare] = -1


def _batched(rows):
    """Rows in batches of some BATCH_BYTES: a batch takes longer than a small row does."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= BATCH_BYTES:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _by_part(batches, reduce):
    """Calls reduce(part, payloads by kind) for each run of equal parts (rows sorted by part, kind)."""
    part, held = None, defaultdict(list)
    for batch in batches:
        for kind, p, payload in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part and held:
                yield from _batched(reduce(part, held))
                held = defaultdict(list)
            part = p
            held[kind].append(payload)
    if held:
        yield from _batched(reduce(part, held))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, minlength=n)


def count_bucket(bucket: int, payloads: list[bytes], plan: Plan):
    """Counts a bucket's trigrams. Rows: model (the counted trigrams and the tokens still open), sums by chunk, stats."""
    packets = sorted((_unpack(p) for p in payloads), key=lambda p: int(p["chunk"][0]))
    payloads.clear()
    held = [np.unpackbits(p["held"])[: int(p["n"][0])].astype(bool) for p in packets]
    n_common = len(plan.common)
    rare = [_keys(p["words"]) for p in packets]
    words = _distinct(np.concatenate(rare))
    n = n_common + len(words)
    keys = np.r_[plan.common, words]

    place = [np.searchsorted(words, r) for r in rare]

    def own(p, at, names):
        """The numbers of a packet's words: frequent ones have the same everywhere."""
        x = p[names].astype(np.int64)
        own_words = np.flatnonzero(x >= n_common)
        x[own_words] = n_common + at[x[own_words] - n_common]
        return x

    # contexts (v, u) and trigrams of all packets, numbered in their order
    pv = [np.repeat(own(p, at, "v"), p["v_run"].astype(np.int64)) for p, at in zip(packets, place)]
    pu = [own(p, at, "u") for p, at in zip(packets, place)]
    contexts, context = _numbered(np.concatenate(pv), n, np.concatenate(pu))
    del pv, pu
    context = np.repeat(context, np.concatenate([p.pop("u_run") for p in packets]).astype(np.int64))
    grams, gram = _numbered(context, n, np.concatenate([own(p, at, "w") for p, at in zip(packets, place)]))
    del context, rare, place
    c = np.zeros(len(grams), dtype=np.int64)
    spans = np.cumsum([0, *(len(p["w"]) for p in packets)])
    cells = []
    for k, p in enumerate(packets):
        g = np.repeat(gram[spans[k] : spans[k + 1]], p["w_run"].astype(np.int64))
        cells.append(g)
        train = ~held[k][p["doc"]]
        c += np.bincount(g[train], p["count"][train].astype(np.int64) + 1, minlength=len(c)).astype(np.int64)
    ctx, w = grams // n, grams % n
    total = _sums(ctx, c, len(contexts)).astype(np.int64)
    total += (total > 0) & ~_any(ctx, (c > 0) & (c <= K), len(contexts))
    v = contexts // n
    new_v = np.r_[True, v[1:] != v[:-1]]
    v_words = v[new_v]
    v_of = np.cumsum(new_v) - 1
    hot_at, v_hot = _place(plan.hot, keys[v_words])
    c_v = _sums(v_of[ctx], c, len(v_words)).astype(np.int64)  # a word stands before another as often as it occurs
    pairs, pair = np.unique(v_of[ctx] * n + w, return_inverse=True)
    c_pair = _sums(pair, c, len(pairs)).astype(np.int64)
    cold_pair = ~v_hot[pairs // n]
    seen = lambda a: np.bincount(a[(a > 0) & (a <= K + 1)], minlength=K + 2)
    yield "stats", 0, _pack(
        n=np.array([c_v.sum()]), v=np.array([(c_v[~v_hot] > 0).sum()]), r3=seen(c), r2=seen(c_pair[cold_pair]), hot_word=hot_at[v_hot], hot_count=c_v[v_hot],
    )
    # tokens whose trigram was seen are settled but for the discounts; the others stay open
    with np.errstate(divide="ignore"):
        base, log_total, log_c = np.log10(c_v + SMOOTH), np.log10(np.maximum(total, 1)), np.log10(np.maximum(c, 1))
    kept = []
    is_word = (keys[v_words] != START) & ~v_hot
    for k, p in enumerate(packets):
        g, doc, count = cells[k], p["doc"].astype(np.int64), p["count"].astype(np.int64) + 1
        there = np.zeros(len(held[k]), dtype=bool)
        there[doc] = True
        docs = np.flatnonzero(there)
        local = (np.cumsum(there) - 1)[doc]
        x, cg = v_of[ctx[g]], c[g]
        known = cg > 0
        real = np.stack(
            [
                _sums(local, np.where(is_word[x], count * base[x], 0), len(docs)),
                _sums(local, np.where(known, count * ((cg > K) * log_c[g] - log_total[ctx[g]]), 0), len(docs)),
            ],
            axis=1,
        )
        low = _sums(local * (K + 2) + np.minimum(cg, K + 1), count, len(docs) * (K + 2)).reshape(-1, K + 2)[:, 1 : K + 1]
        yield "sums", int(p["chunk"][0]), _pack(
            doc=docs, real=_steps_of(real), known=_sums(local, np.where(is_word[x] & (c_v[x] > 0), count, 0), len(docs)).astype(np.int64), low=low.astype(np.int64)
        )
        if not known.all():
            kept.append((np.full((~known).sum(), int(p["chunk"][0])), doc[~known], count[~known], g[~known]))
    open_ = [np.concatenate(x) for x in zip(*kept)] if kept else [np.zeros(0, dtype=np.int64)] * 4
    yield "model", bucket, _pack(
        words=_steps(words), v=v_words, v_run=_runs(new_v), u=contexts % n, u_run=np.bincount(ctx, minlength=len(contexts)), w=w, count=c,
        chunk=open_[0], doc=open_[1], n=open_[2], gram=open_[3],
    )


def _steps_of(x: np.ndarray) -> np.ndarray:
    """Real numbers as whole steps, without a sign of their own."""
    whole = np.round(x / STEP).astype(np.int64)
    return whole << 1 ^ whole >> 63


def _reals_of(steps: np.ndarray) -> np.ndarray:
    steps = steps.astype(np.int64)
    return (steps >> 1 ^ -(steps & 1)) * STEP


def ask(bucket: int, payload: bytes, plan: Plan):
    """What a bucket of the stored table tells and asks the parts that have the counts of w: its own counts of words (words), the
    words whose counts it needs (asks), its counts of the pairs of frequent words (pairs)."""
    s = Stored(payload, plan)
    c_v = _sums(s.v_of[s.ctx], s.c, len(s.v_words)).astype(np.int64)
    yield "words", bucket, _pack_words(s.keys[s.v_words[~s.v_hot]], c_v[~s.v_hot])
    asked = s.keys[s.cold_words(plan)]
    to = _bucket(asked, np.zeros_like(asked), plan.buckets)
    for b in np.unique(to).tolist():
        yield "asks", b, _pack(src=np.array([bucket]), words=_steps(asked[to == b]))
    hot = np.flatnonzero(s.v_hot[s.pair_v])
    hv, hw, hc = s.hot_at[s.pair_v[hot]], s.keys[s.pair_w[hot]], s.c_pair[hot]
    for b, mine in _dealt(hv, hw, plan):
        yield "pairs", b, _pack(src=np.array([bucket]), v=hv[mine], w=hw[mine], count=hc[mine])


def _any(at: np.ndarray, flags: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[at[flags]] = True
    return out


def _pack_words(keys: np.ndarray, counts: np.ndarray) -> bytes:
    order = np.argsort(keys)
    return _pack(words=_steps(keys[order]), count=counts[order])


def _dealt(hv: np.ndarray, hw: np.ndarray, plan: Plan):
    """(part, rows in order of v and w) of pairs of frequent words v: where the counts of w are, or by both if w is frequent too."""
    _, w_hot = _place(plan.hot, hw)
    to = _bucket(hw, np.where(w_hot, hv + 1, 0).astype(np.uint64), plan.buckets)
    order = np.lexsort((hw, hv, to))
    cuts = np.searchsorted(to[order], np.arange(plan.buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def answer_part(part: int, held: dict[str, list[bytes]], plan: Plan):
    """The counts that buckets asked for (answers, by bucket), and what the pairs of frequent words add up to (hot, stats)."""
    own = [_unpack(p) for p in held.get("words", [])]
    words = np.concatenate([_keys(p["words"]) for p in own]) if own else np.zeros(0, dtype=np.uint64)
    counts = np.concatenate([p["count"] for p in own]).astype(np.int64) if own else np.zeros(0, dtype=np.int64)

    def count_of(keys):
        at, there = _place(words, keys)
        return np.where(there, counts[at], 0) if len(words) else np.zeros(len(keys), dtype=np.int64)

    answers: dict[int, dict[str, np.ndarray]] = defaultdict(dict)
    for p in held.get("asks", []):
        p = _unpack(p)
        answers[int(p["src"][0])]["word"] = count_of(_keys(p["words"]))
    asked = [_unpack(p) for p in held.get("pairs", [])]
    if asked:
        v, w, c = (np.concatenate([p[k] for p in asked]) for k in ("v", "w", "count"))
        order = np.lexsort((w, v))
        new = np.r_[True, (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])]
        group = np.empty(len(v), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        sums = _sums(group, c, int(new.sum())).astype(np.int64)
        spans = np.cumsum([0, *(len(p["v"]) for p in asked)])
        for p, a, b in zip(asked, spans[:-1], spans[1:]):
            answers[int(p["src"][0])]["pair"] = sums[group[a:b]]
        there = sums > 0
        v, w, sums = v[order][new][there].astype(np.int64), w[order][new][there], sums[there]
        at, w_hot = _place(plan.hot, w)
        yield "stats", 0, _pack(
            n=np.zeros(1, dtype=np.int64), v=np.zeros(1, dtype=np.int64), r3=np.zeros(K + 2, dtype=np.int64), r2=np.bincount(sums[sums <= K + 1], minlength=K + 2),
            hot_word=v[:0], hot_count=v[:0],
        )
        yield "hot", 0, _pack(v=v, count=sums, c_w=np.where(w_hot, 0, count_of(w)), hot_w=np.where(w_hot, at + 1, 0))
    for src, found in sorted(answers.items()):
        none = np.zeros(0, dtype=np.int64)
        yield "answers", src, _pack(part=np.array([part]), word=found.get("word", none), pair=found.get("pair", none))


def discounts(r: np.ndarray) -> np.ndarray:
    """d_1 .. d_K by Good and Turing from counts of counts r[0..K+1]; absolute discounting where that isn't within (0, 1)."""
    with np.errstate(all="ignore"):
        n = r.astype(float)
        rest = (K + 1) * n[K + 1] / n[1]
        star = np.array([(k + 1) * n[k + 1] / n[k] / k for k in range(1, K + 1)])
        d = (star - rest) / (1 - rest)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        off = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 and n[2] > 0 else 0.5
        d = (np.arange(1, K + 1) - off) / np.arange(1, K + 1)
    return d


class Totals:
    """What the driver gathers: corpus totals, discounts, and of the frequent words their counts and their contexts' sums."""

    def __init__(self, packets: list[bytes], plan: Plan):
        found = [_unpack(p) for p in packets]
        self.hot = np.zeros(len(plan.hot), dtype=np.int64)
        for f in found:
            np.add.at(self.hot, f["hot_word"].astype(np.int64), f["hot_count"].astype(np.int64))
        add = lambda k: sum((f[k].astype(np.int64) for f in found), np.zeros(K + 2, dtype=np.int64))
        self.d2, self.d3 = discounts(add("r2")), discounts(add("r3"))
        self.n = int(sum(int(f["n"][0]) for f in found))  # as many tokens as words that stand before one
        start, _ = _place(plan.hot, np.array([START], dtype=np.uint64))
        self.docs = int(self.hot[start[0]])
        is_word = plan.hot != np.uint64(START)
        self.v = int(sum(int(f["v"][0]) for f in found)) + int((self.hot[is_word] > 0).sum()) + (self.docs > 0)
        self.z = self.n + SMOOTH * (self.v + 1)
        end, _ = _place(plan.hot, np.array([END], dtype=np.uint64))
        self.c1 = self.hot.copy()  # as a word: the end never stands before one, the start is none
        self.c1[end[0]], self.c1[start[0]] = self.docs, 0

    def set_contexts(self, low: np.ndarray, high: np.ndarray, seen: np.ndarray, c_words: np.ndarray) -> None:
        """Sums over the pairs of each frequent v: pairs of counts 1..K, the counts beyond, pairs, and the counts of their w."""
        self.total = (low @ np.arange(1, K + 1) + high).astype(np.int64)
        self.total += (self.total > 0) & (low.sum(axis=1) == 0)
        self.alpha = backoff(low, high, self.total, self.d2, (c_words + SMOOTH * seen) / self.z)


def cut(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(c <= K, c * np.r_[0, d][np.minimum(c, K)], c)


def backoff(low: np.ndarray, high: np.ndarray, total: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """alpha of contexts: the mass that the words seen leave, over the lower order's mass of the others; 1 for contexts not seen."""
    left = 1 - (low @ (np.arange(1, K + 1) * d) + high) / np.maximum(total, 1)
    return np.where(total > 0, left / (1 - lower), 1.0)


def _classes(at: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.bincount(at.astype(np.int64) * (K + 2) + np.clip(c, 0, K + 1).astype(np.int64), minlength=n * (K + 2)).reshape(-1, K + 2)[:, 1 : K + 1]
    return low.astype(float), _sums(at, np.where(c > K, c, 0), n)


class Stored:
    """A bucket of the stored table: its trigrams with counts, and the pairs and contexts that follow from them."""

    def __init__(self, payload: bytes, plan: Plan):
        p = _unpack(payload)
        self.open = [p[k].astype(np.int64) for k in ("chunk", "doc", "n", "gram")]
        self.keys = np.r_[plan.common, _keys(p["words"])]
        self.n = len(self.keys)
        self.v_words, self.u, self.w, self.c = (p.pop(k).astype(np.int32) if k != "count" else p.pop(k).astype(np.int64) for k in ("v", "u", "w", "count"))
        self.v_of = np.repeat(np.arange(len(self.v_words), dtype=np.int32), p.pop("v_run").astype(np.int64))
        self.ctx = np.repeat(np.arange(len(self.u), dtype=np.int32), p.pop("u_run").astype(np.int64))
        del p
        self.hot_at, self.v_hot = _place(plan.hot, self.keys[self.v_words])
        pairs, self.pair = _numbered(self.v_of[self.ctx], self.n, self.w)
        self.pair_v, self.pair_w = (pairs // self.n).astype(np.int32), (pairs % self.n).astype(np.int32)
        del pairs
        self.c_pair = _sums(self.pair, self.c, len(self.pair_v)).astype(np.int64)

    def cold_words(self, plan: Plan) -> np.ndarray:
        """The words w, frequent ones aside, in the order of their keys, whose counts open tokens need: those after a v with one."""
        needed = _any(self.v_of[self.ctx[self.open[3]]], np.ones(len(self.open[3]), dtype=bool), len(self.v_words))
        met = np.zeros(self.n, dtype=bool)
        met[self.w[needed[self.v_of[self.ctx]]]] = True
        found = np.flatnonzero(met)
        found = found[~_place(plan.hot, self.keys[found])[1]]
        return found[np.argsort(self.keys[found])]


def settle_bucket(payload: bytes, answers: list[bytes], totals: Totals, plan: Plan):
    """Evaluates the open tokens of a bucket, order by order; rows of kind rest, by chunk."""
    s = Stored(payload, plan)
    chunk, doc, n, gram = s.open
    if not len(gram):
        return
    found = {int(p["part"][0]): p for p in map(_unpack, answers)}
    # unigrams
    c_word = np.zeros(s.n, dtype=np.int64)
    w_words = np.flatnonzero(np.bincount(s.w, minlength=s.n))
    at, w_hot = _place(plan.hot, s.keys[w_words])
    c_word[w_words[w_hot]] = totals.c1[at[w_hot]]
    cold = s.cold_words(plan)
    to = _bucket(s.keys[cold], np.zeros(len(cold), dtype=np.uint64), plan.buckets)
    for b in np.unique(to).tolist():
        c_word[cold[to == b]] = found[b]["word"]
    p1 = (c_word + SMOOTH) / totals.z
    # pairs; those of frequent words are counted elsewhere
    hot_pair = np.flatnonzero(s.v_hot[s.pair_v])
    c_pair = s.c_pair.copy()
    for b, mine in _dealt(s.hot_at[s.pair_v[hot_pair]], s.keys[s.pair_w[hot_pair]], plan):
        c_pair[hot_pair[mine]] = found[b]["pair"]
    size = len(s.v_words)
    low, high = _classes(s.pair_v, c_pair, size)
    total2 = (low @ np.arange(1, K + 1) + high).astype(np.int64)
    total2 += (total2 > 0) & (low.sum(axis=1) == 0)
    alpha2 = backoff(low, high, total2, totals.d2, _sums(s.pair_v, np.where(c_pair > 0, p1[s.pair_w], 0), size))
    total2 = np.where(s.v_hot, totals.total[s.hot_at], total2)
    alpha2 = np.where(s.v_hot, totals.alpha[s.hot_at], alpha2)
    p2 = np.where(c_pair > 0, cut(c_pair, totals.d2) / np.maximum(total2[s.pair_v], 1), alpha2[s.pair_v] * p1[s.pair_w])
    # contexts of two words
    low, high = _classes(s.ctx, s.c, len(s.u))
    total3 = (low @ np.arange(1, K + 1) + high).astype(np.int64)
    total3 += (total3 > 0) & (low.sum(axis=1) == 0)
    alpha3 = backoff(low, high, total3, totals.d3, _sums(s.ctx, np.where(s.c > 0, p2[s.pair], 0), len(s.u)))
    value = n * np.log10(alpha3[s.ctx[gram]] * p2[s.pair[gram]])
    order = np.lexsort((doc, chunk))
    chunk, doc, value = chunk[order], doc[order], value[order]
    cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        docs, local = np.unique(doc[a:b], return_inverse=True)
        yield "rest", int(chunk[a]), _pack(doc=docs, value=np.bincount(local, value[a:b]))


def sum_chunk(held: dict[str, list[bytes]], totals: Totals, plan: Plan) -> pa.RecordBatch:
    """The scored documents of a chunk."""
    docs = _unpack(held["docs"][0])
    size = docs["size"].astype(np.int64)
    n = len(size)
    base = np.full(n, np.log10(totals.docs + SMOOTH))  # the end
    score, known = np.zeros(n), np.full(n, int(totals.docs > 0), dtype=np.int64)
    logs = np.log10(np.arange(1, K + 1) * totals.d3)
    ordered = lambda kind: sorted(held.get(kind, []))  # noqa: E731  sums don't depend on the order of arrival
    for p in map(_unpack, ordered("sums")):
        at = p["doc"].astype(np.int64)
        real = _reals_of(p["real"])
        base[at] += real[:, 0]
        score[at] += real[:, 1] + p["low"] @ logs
        known[at] += p["known"].astype(np.int64)
    for p in map(_unpack, ordered("rest")):
        score[p["doc"].astype(np.int64)] += p["value"]
    at, word, count = (docs[k].astype(np.int64) for k in ("hot_doc", "hot_word", "hot_count"))
    np.add.at(base, at, count * np.log10(totals.hot[word] + SMOOTH))
    np.add.at(known, at, np.where(totals.hot[word] > 0, count, 0))
    null = np.unpackbits(docs["null"])[:n].astype(bool)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(docs["doc_id"].view(np.int64), mask=null), pa.array(np.unpackbits(docs["held"])[:n].astype(bool)), pa.array(size), pa.array(known),
            pa.array(np.full(n, totals.n)), pa.array(base - size * np.log10(totals.z)), pa.array(score),
        ],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _store(spark: SparkSession, df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    path = fresh_path(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(_TABLE).parquet(path).select("kind", "part", "payload"), path


def frequent_words(texts: DataFrame, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the words to spread (the end and the start always) and of those that get a number, from about SAMPLE of n texts,
    drawn row by row."""
    counts: Counter = Counter()
    drawn = texts.select("text") if n <= SAMPLE else texts.select("text").sample(SAMPLE / n, 7)
    for batch in drawn.toArrow().to_batches(max_chunksize=500):
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
    least = sum(counts.values()) / (4 * buckets)
    hot = {END, START, *(word_key(w) for w, n in counts.most_common(HOT) if n >= least)}
    common = hot | {word_key(w) for w, n in counts.most_common(COMMON) if n > 1}
    return tuple(np.array(sorted(x), dtype=np.uint64) for x in (hot, common))


def _read_part(path: str, part: int) -> list[bytes]:
    """The payloads of one part of a table that is partitioned by part."""
    import pyarrow.parquet as pq

    fs, root = file_system(path)
    files = fs.get_file_info(pa.fs.FileSelector(f"{root}/part={part}", allow_not_found=True))
    return [x for f in sorted(f.path for f in files if f.path.endswith(".parquet")) for x in pq.ParquetFile(fs.open_input_file(f)).read(["payload"])["payload"].to_pylist()]


def ngrams(spark: SparkSession, model: DataFrame, plan: Plan) -> DataFrame:
    """The stored table, row by row: v2, v1 (keys of the history's words, the last one v1), w, count of the trigrams that were learnt."""

    def run(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                s = Stored(payload, plan)
                seen = s.c > 0
                signed = lambda at: pa.array(s.keys[at[seen]].view(np.int64))
                yield pa.RecordBatch.from_arrays([signed(s.u[s.ctx]), signed(s.v_words[s.v_of[s.ctx]]), signed(s.w), pa.array(s.c[seen])], names=["v2", "v1", "w", "count"])

    return model.where("kind = 'model'").select("payload").mapInArrow(run, "v2 long, v1 long, w long, count long")


def learn(spark: SparkSession, rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, Plan]:
    """Packs and counts rows (doc_id, text): the table of kinds docs, sums, model, stats."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    buckets = max(1, -(-size // bucket_bytes))
    plan = Plan(buckets, *frequent_words(rows, n, buckets))

    def pack(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")))
                part = batch.slice(start, stop - start)
                yield from _batched(pack_chunk(chunk, part.column(0).to_pylist(), part.column(1).to_pylist(), plan))
                chunk, start = chunk + 1, stop
                del part
                trim()

    def count(batches):
        def reduce(part, held):
            for payload in held.get("docs", []):
                yield "docs", part, payload
            if "grams" in held:
                yield from count_bucket(part, held.pop("grams"), plan)
                trim()

        return _by_part(batches, reduce)

    dealt = rows.mapInArrow(pack, _TABLE).repartition(buckets, "part").sortWithinPartitions("part", "kind")
    return _store(spark, dealt.mapInArrow(count, _TABLE), "counts", "kind")[0], plan


def score_documents(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Learns from rows whose crc32(doc_id as text) mod FOLDS is not 0. Null texts count as empty (the end alone), a null
    doc_id as the empty text. Repeated rows are learnt and scored each. An empty table gives none. Other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first, plan = learn(spark, rows, bucket_bytes)
    dealt = lambda df: df.repartition(plan.buckets, "part").sortWithinPartitions("part", "kind")
    model = first.where("kind = 'model'").select("part", "payload")

    def asking(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batched(ask(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), plan))
                trim()

    asked = dealt(model.mapInArrow(asking, _TABLE))
    answered = asked.mapInArrow(lambda batches: _by_part(batches, lambda part, held: answer_part(part, held, plan)), _TABLE)
    second, _ = _store(spark, answered, "answered", "kind")
    _, answers = _store(spark, second.where("kind = 'answers'").repartition(plan.buckets, "part"), "answers", "part")
    stats = first.where("kind = 'stats'").unionByName(second.where("kind = 'stats'"))
    totals = Totals([bytes(r[0]) for r in stats.select("payload").toLocalIterator()], plan)

    def hot_rows(batches):
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                p = _unpack(payload)
                v, c = p["v"].astype(np.int64), p["count"].astype(np.int64)
                found, at = np.unique(v, return_inverse=True)
                low, high = _classes(at, c, len(found))
                hot_w = p["hot_w"].astype(np.int64)
                c_w = p["c_w"].astype(np.int64) + np.where(hot_w > 0, totals.c1[np.maximum(hot_w - 1, 0)], 0)
                columns = [found, *low.astype(np.int64).T, high.astype(np.int64), np.bincount(at), _sums(at, c_w, len(found)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

    names = ["v", *(f"low{r}" for r in range(1, K + 1)), "high", "seen", "words"]
    sums = second.where("kind = 'hot'").select("payload").mapInArrow(hot_rows, ", ".join(f"{x} long" for x in names))
    hot = np.zeros((len(plan.hot), len(names) - 1))
    for r in sums.groupBy("v").agg(*[F.sum(x).alias(x) for x in names[1:]]).collect():  # at most HOT rows
        hot[r["v"]] = [r[x] for x in names[1:]]
    totals.set_contexts(hot[:, :K], hot[:, K], hot[:, K + 1], hot[:, K + 2])

    def settle(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _batched(settle_bucket(batch.column(1)[i].as_py(), _read_part(answers, batch.column(0)[i].as_py()), totals, plan))
                trim()

    rest, _ = _store(spark, model.mapInArrow(settle, _TABLE), "rest", "kind")

    def finish(batches):
        part, held = None, defaultdict(list)
        for batch in batches:
            for kind, p, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield sum_chunk(held, totals, plan)
                    held = defaultdict(list)
                    trim()
                part = p
                held[kind].append(payload)
        if held:
            yield sum_chunk(held, totals, plan)

    return dealt(first.where("kind IN ('docs', 'sums')").unionByName(rest)).mapInArrow(finish, SCORED)

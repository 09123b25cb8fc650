"""Language identification by segmentation-marginalised unigram models.

Each language has probabilities of the pieces of a fixed public vocabulary. The probability of a word is the sum
over all its segmentations into pieces (forward algorithm); a text is the product of its words. Piece
probabilities are fitted by expectation maximisation over the word counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import crc_mod, worker_cache

#: Labelled rows of each language that the fit takes, about (rows are drawn by a hash of their id).
TRAIN_ROWS = 600
ROUNDS = 4
UNDETERMINED = "und"
#: Letters of a word that the lattice of many words takes; longer runs have a recursion of their own, and in the fit alone are
#: cut into parts, of which only the first starts a word.
_LONGEST = 24


_RUN = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 250_000
_FLOOR = 1e-7


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters (str.isalpha)."""
    found = _RUN.findall((text or "").lower())
    if not found or "".join(found).isalpha():
        return found
    # the expression also lets numerals pass that are neither digits nor letters
    return [w for f in found for w in (f if f.isalpha() else "".join(c if c.isalpha() else " " for c in f)).split()]


def parts(word: str) -> list[str]:
    """A word as the fit takes it: with the mark of a word's start, in parts of at most _LONGEST letters."""
    return [" " + word] if len(word) <= _LONGEST else [" " * (i == 0) + word[i : i + _LONGEST] for i in range(0, len(word), _LONGEST)]


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that spell lower-case words; the mark of a word's start is kept as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p.strip().isalpha() and p == p.lower() and " " not in p[1:]})


def prefix_tree(pieces: list[str]) -> dict[str, int]:
    """Number of each piece; -1 for what only starts pieces, so that a search along a word can stop early."""
    tree = {p[:k]: -1 for p in pieces for k in range(1, len(p))}
    return tree | {p: i for i, p in enumerate(pieces)}


@dataclass
class Lattice:
    """Edges of the segmentation lattices of some words, ordered by end position."""

    word: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    bounds: list[int]
    length: np.ndarray


@dataclass
class Model:
    langs: list[str]
    tree: dict[str, int]
    probs: np.ndarray  # (pieces + 1, langs); the last row is any single letter outside the vocabulary
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def log_probs(self, found: list[str]) -> np.ndarray:
        """log probability of each word in each language, summed over its segmentations."""
        out = np.zeros((len(found), self.probs.shape[1]))
        short = [i for i, w in enumerate(found) if len(w) <= _LONGEST]
        if short:
            lattice = build_lattice([" " + found[i] for i in short], self.tree, len(self.probs) - 1)
            out[short] = np.log(forward(lattice, self.probs)[lattice.length, np.arange(len(short))])
        for i, w in enumerate(found):
            if len(w) > _LONGEST:
                out[i] = self.long_log_prob(w)
        return out

    def long_log_prob(self, word: str) -> np.ndarray:
        """The same sum along one long run of letters: only the last few positions are held, scaled to stay in range."""
        text, get, unknown = " " + word, self.tree.get, self.probs[-1]
        n, size = len(text), self.probs.shape[1]
        ahead = {0: np.ones(size)}
        log_scale = np.zeros(size)
        for i in range(n):
            here = ahead.pop(i, None)
            if here is None:
                continue
            if (here < 1e-100).any():
                factor = np.where(here < 1e-100, 1 / np.maximum(here, 1e-300), 1.0)
                log_scale -= np.log(factor)
                here = here * factor
                ahead = {j: a * factor for j, a in ahead.items()}
            known = False
            for j in range(i + 1, n + 1):
                if (p := get(text[i:j])) is None:
                    break
                if p >= 0:
                    ahead[j] = ahead.get(j, 0) + here * self.probs[p]
                    known = known or j == i + 1
            if not known:
                ahead[i + 1] = ahead.get(i + 1, 0) + here * unknown
        return np.log(ahead[n]) + log_scale


def build_lattice(found: list[str], tree: dict[str, int], unknown: int) -> Lattice:
    """found: words with the mark of their start, or parts without; unknown: the number of a single letter outside the vocabulary."""
    # An edge is one number, (end, word, start, piece) from its highest part to its lowest.
    length_radix, piece_radix = max(map(len, found), default=0) + 1, unknown + 1
    word_step = length_radix * piece_radix
    end_step = max(len(found), 1) * word_step
    packed: list[int] = []
    add, get = packed.append, tree.get
    for w, text in enumerate(found):
        n = len(text)
        for i in range(n):
            own = w * word_step + i * piece_radix
            known = False
            for j in range(i + 1, n + 1):
                if (p := get(text[i:j])) is None:
                    break
                if p >= 0:
                    add(own + j * end_step + p)
                    known = known or j == i + 1
            if not known:
                add(own + (i + 1) * end_step + unknown)
    edges = np.sort(np.array(packed, dtype=np.int64))
    ends, edges = np.divmod(edges, end_step)
    word, edges = np.divmod(edges, word_step)
    start, piece = np.divmod(edges, piece_radix)
    length = np.array([len(w) for w in found], dtype=np.int64)
    bounds = np.searchsorted(ends, np.arange(length.max(initial=0) + 2)).tolist()
    return Lattice(word, start, piece, bounds, length)


def forward(lattice: Lattice, probs: np.ndarray) -> np.ndarray:
    """alpha[position, word, language]: probability of all segmentations of the word's prefix."""
    n, size = len(lattice.length), probs.shape[1]
    alpha = np.zeros((len(lattice.bounds) - 1, n, size))
    alpha[0] = 1
    for j in range(1, len(lattice.bounds) - 1):
        s = slice(lattice.bounds[j], lattice.bounds[j + 1])
        own = lattice.word[s]  # in ascending order
        if len(own):
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            alpha[j, own[first]] = np.add.reduceat(alpha[lattice.start[s], own] * probs[lattice.piece[s]], first)
    return alpha


def fit_language(lattice: Lattice, counts: np.ndarray, n_pieces: int, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (n_pieces + 1) by expectation maximisation; every piece keeps a floor."""
    probs = np.full((n_pieces + 1, 1), 1.0 / (n_pieces + 1))
    ends = np.repeat(np.arange(len(lattice.bounds) - 1), np.diff(lattice.bounds + [len(lattice.word)])[: len(lattice.bounds) - 1])
    for _ in range(rounds):
        alpha = forward(lattice, probs)[:, :, 0]
        beta = np.zeros_like(alpha)
        index = np.arange(len(lattice.length))
        beta[lattice.length, index] = 1
        for j in range(len(lattice.bounds) - 2, 0, -1):
            s = slice(lattice.bounds[j], lattice.bounds[j + 1])
            np.add.at(beta, (lattice.start[s], lattice.word[s]), beta[j, lattice.word[s]] * probs[lattice.piece[s], 0])
        total = alpha[lattice.length, index]
        share = alpha[lattice.start, lattice.word] * probs[lattice.piece, 0] * beta[ends, lattice.word]
        share *= (counts / total)[lattice.word]
        expected = np.bincount(lattice.piece, share, minlength=n_pieces + 1)
        probs = ((expected + 1e-3) / (expected.sum() + 1e-3 * (n_pieces + 1)))[:, None]
    return np.maximum(probs[:, 0], _FLOOR)


def _word_counts(batches):
    """(lang, word, n) of one partition."""
    counts: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, p) for w in words(text) for p in parts(w))
    yield pa.RecordBatch.from_pylist(
        [{"lang": lang, "word": w, "n": n} for (lang, w), n in counts.items()],
        schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]),
    )


def train(
    labelled: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS
) -> Model:
    """Fits the models on about ``rows`` labelled rows of each language (whole texts; all rows where there are fewer).

    Rows with a null language are no examples. Without any labelled row the model has no language.
    """
    labelled = labelled.select(
        F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # as many as the model has languages
    langs = sorted(sizes)
    pieces = vocabulary(vocabulary_path)
    tree = prefix_tree(pieces)
    if not langs:
        return Model([], tree, np.zeros((len(pieces) + 1, 0)))
    shares = F.create_map(*[F.lit(x) for lang in langs for x in (lang, rows / sizes[lang])])
    drawn = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < shares[F.col("lang")]  # all rows where there are fewer
    sample = labelled.where(drawn).select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    table = sample.groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").toPandas()
    probs = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    for k, lang in enumerate(langs):
        own = table[table.lang == lang]
        if len(own):
            probs[:, k] = fit_language(build_lattice(own.word.tolist(), tree, len(pieces)), own.n.to_numpy(float), len(pieces))
    return Model(langs, tree, probs)


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Best language and its posterior (equal priors); und and 0 where a text has no letter or no language is known."""
    cache = worker_cache("langid")
    if model.key not in cache:
        cache.clear()
    if model.key not in cache or len(cache[model.key][0]) > _CACHE_WORDS:
        cache.clear()
        cache[model.key] = ({}, np.zeros((0, len(model.langs))))
    known, logs = cache[model.key]
    counted = [Counter(words(t)) if model.langs else Counter() for t in texts]
    has = [bool(c) for c in counted]
    long: dict[int, np.ndarray] = {}  # runs beyond the lattice are scored where they stand, and not kept
    for i, c in enumerate(counted):
        if over := [w for w in c if len(w) > _LONGEST]:
            long[i] = sum(c.pop(w) * model.long_log_prob(w) for w in over)
    new = list(dict.fromkeys(w for c in counted for w in c if w not in known))
    if new:
        known.update(zip(new, range(len(known), len(known) + len(new))))
        logs = np.concatenate([logs, *(model.log_probs(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        cache[model.key] = (known, logs)
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    rows = [i for i, some in enumerate(has) if some]
    if not rows:
        return langs, scores
    at = np.array([known[w] for i in rows for w in counted[i]], dtype=np.int64)
    n = np.array([k for i in rows for k in counted[i].values()], dtype=float)
    ends = np.cumsum([len(counted[i]) for i in rows])
    sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(logs[at] * n[:, None], axis=0)]) if len(at) else np.zeros((1, len(model.langs)))
    totals = sums[ends] - sums[np.r_[0, ends[:-1]]]
    for k, i in enumerate(rows):
        if i in long:
            totals[k] += long[i]
    totals = np.exp(totals - totals.max(axis=1, keepdims=True))
    best = totals.argmax(axis=1)
    share = totals[np.arange(len(rows)), best] / totals.sum(axis=1)
    for i, b, x in zip(rows, best.tolist(), share.tolist()):
        langs[i], scores[i] = model.langs[b], x
    return langs, scores


def predict(model: Model, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_cols: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (and pass_cols) of each row; ties go to the language that sorts first.

    Only the text is looked at. Null texts and texts without a letter are 'und' with score 0. Repeated rows give
    a row each; an empty table gives none. Words are scored once for each worker and kept in a bounded cache.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), *pass_cols, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]] + ["lang_pred string", "score double"])

    def run(batches):
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            texts = batch.column(batch.num_columns - 1)
            for i in range(0, len(texts), 256):
                found = predict_texts(model, texts.slice(i, 256).to_pylist())
                langs += found[0]
                scores += found[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return docs.mapInArrow(run, schema)


def identify(spark: SparkSession, docs: DataFrame, vocabulary_path: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang).

    Learns from rows with a language whose crc32(doc_id as text) mod 4 is not 2; the others are held out.
    """
    model = train(docs.where(crc_mod(F.col("doc_id"), 4) != 2), vocabulary_path, rows=rows)
    return predict(model, docs).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def without_unknown(docs: DataFrame, vocabulary_path: str, least: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose text has a language: not 'und' and with a posterior of ``least`` or more. Map-only.

    Null texts and texts without a letter go; repeated rows share their fate, as only the text is looked at. Without any
    labelled row every text with a letter stays. Columns, of any name, and types are those of docs; no rows give none.
    """
    model, place = train(docs, vocabulary_path, rows=rows), docs.columns.index("text")
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))  # no language is known: whatever has a letter stays

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                langs, scores = predict_texts(model, part.column(place).to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and s >= least for lang, s in zip(langs, scores)]))

    return docs.mapInArrow(run, docs.schema)

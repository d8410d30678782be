"""Toxicity scores of text restored by a noisy-channel decoder.

Writers hide words by leetspeak (m0r0n), spacing (m o r o n) and repetition (moooron). Each suspicious
stretch becomes a lattice: a character may stand for itself, for the letters it imitates, or for
nothing; a run may be one or two letters or all of them; spaced letters may be one word or several. A
Viterbi search takes the path that a trigram character model of the whole corpus and the channel's
costs like best. The restored words are scored together with the text's own words.

A word's features are itself and its beginnings of four to eight bytes. Over the labelled rows of the
training folds, a feature that is significantly commoner in toxic texts gets the share of toxic texts
among those that hold it, drawn towards the overall share; a text's score is the chance that at least
one of its words is toxic.

Rows and values, case by case:
- null or empty text, or text without a word: scored with the chance of a text without toxic words.
- labels that are null or without a document teach nothing; a document labelled twice counts once for
  each label, and so does a text that stands in several documents, equal but for A-Z and white space;
  every other labelled text counts, near copies too. A null id is not held out and joins no label. No
  labels at all: every score is 0.
- repeated rows: each gets its own row. Very long texts: whole. Empty tables: no rows.
- further columns: ignored. lang, source and id are never read for a score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvlake.llm.arrow import add_columns, column, pieces, small_batches
from solvlake.llm.decontam import member
from solvlake.llm.shared import cut
from solvlake.llm.words import ALNUM, NOT_SPACE, Chunk, byte_class, chunks, mix, whole_hashes

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Texts that stand for the overall share when a feature's share is estimated.
PRIOR_TEXTS = 1.0
#: Log-likelihood ratio (G squared) that a feature may stay below twice the log of the number of features
#: tried, which is about the largest that so many reach by chance (so about one of them may be chance); and
#: a feature's least chance.
SLACK, LEAST_CHANCE = 4.0, 0.8
#: A feature stays if in so many toxic texts it has this share of the weightiest feature's ratio at least.
LEAST_CREDIT, CREDITED = 2, 0.3
#: The classifier is fitted on so many labelled rows, about: all if there are no more, else those whose ids
#: have the least hashes.
MOST_LABELLED = 1 << 20
BEGINNINGS = (4, 5, 6, 7, 8)

#: The letters that a character imitates.
IMITATES = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t"}
#: Costs in nats: a substituted letter, a dropped symbol, a shortened run, a break between spaced letters.
SUBSTITUTED, DROPPED, SHORTENED, BROKEN = 0.7, 3.0, 0.3, 1.0
#: Characters of decoded stretches that a task keeps at most.
KEPT_CHARS = 1 << 24

_LETTER = byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_LEET = byte_class("".join(IMITATES).encode())
# classes of the character model: 0 border, 1-26 letters, 27 any other byte of a word
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x41:0x5B] = np.arange(1, 27)
_CLASS[0x80:] = 27
_CLASS[0x30:0x3A] = 27
K = 28

SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def trigrams(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of class trigrams over all texts, K x K x K; at most K**3 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K**3, dtype=np.int64)
        for whole in batches:
            for batch in pieces(whole, text_col):
                for c in chunks(column(batch, text_col), NOT_SPACE):
                    # a border between texts keeps their characters apart
                    cls = np.insert(_CLASS[c.data], c.offsets, 0)
                    total += np.bincount((cls[:-2] * K + cls[1:-1]) * K + cls[2:], minlength=K**3) if len(cls) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(K**3)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(K, K, K)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), interpolated with the bigram and unigram shares."""
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + K)
    p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
    return -np.log((counts + 8 * p2) / (counts.sum(axis=2, keepdims=True) + 8))


def lattice(stretch: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """Choices (letters, cost) at each step of a lower-case stretch."""
    steps: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", stretch, re.DOTALL):
        ch, n = run[1], len(run[0])
        if ch in IMITATES:
            choices = [(x * k, SUBSTITUTED * k + (SHORTENED if k < n else 0)) for x in IMITATES[ch] for k in {1, min(n, 2)}]
            steps.append(choices + ([("", DROPPED)] if not ch.isdigit() else []))
        elif ch.isalpha():
            steps.append([(ch * k, SHORTENED * (k < n)) for k in ({1, 2, n} if n > 2 else {1, n} if spaced else {n}) if k <= n])
        else:
            steps.append([("", 0.0)])
        if spaced and ch.isalpha():
            steps.append([("", 0.0), (" ", BROKEN)])
    return steps


def decode(stretch: str, cost: list[list[list[float]]], spaced: bool = False) -> str:
    """The cheapest reading of a stretch, however long; spaces where it breaks into words. A state is
    the last two classes, with its cost and its path: (earlier path, letters)."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in [*lattice(stretch, spaced), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (so_far, path) in states.items():
            for letters, price in choices:
                x, y, total = a, b, so_far + price
                for ch in letters:
                    z = 0 if ch == " " else ord(ch) - 96 if "a" <= ch <= "z" else 27
                    total += cost[x][y][z]
                    x, y = y, z
                if (old := after.get((x, y))) is None or total < old[0]:
                    after[x, y] = (total, (path, letters) if letters else path)
        states = after
    least = min(total for total, _ in states.values())
    return min(spelled(path) for total, path in states.values() if total == least).strip()


def spelled(path: tuple | None) -> str:
    out = []
    while path:
        path, letters = path
        out.append(letters)
    return "".join(reversed(out))


def stretches(c: Chunk) -> list[tuple[int, str, bool]]:
    """(text, stretch, spaced) of everything in the chunk that may be a disguised word."""
    starts, ends = c.spans
    if not len(starts):
        return []
    letter, leet = _LETTER[c.data], _LEET[c.data]
    odd = np.zeros(len(c.data), dtype=bool)
    odd[:-1] |= leet[:-1] & (letter[1:] | leet[1:])
    odd[1:] |= leet[1:] & letter[:-1] & (c.data[1:] >= 0x30) & (c.data[1:] < 0x40)  # a digit, or @, after a letter
    same = (c.data[2:] | 32) == (c.data[1:-1] | 32)
    odd[2:] |= letter[2:] & letter[1:-1] & letter[:-2] & same & ((c.data[1:-1] | 32) == (c.data[:-2] | 32))
    some = np.zeros(len(c.data) + 1, dtype=np.int64)
    np.cumsum(odd, out=some[1:])
    lettered = np.zeros(len(c.data) + 1, dtype=np.int64)
    np.cumsum(letter, out=lettered[1:])
    n_letters = lettered[ends] - lettered[starts]
    text_of = c.text_of_word
    out = []
    for k in np.flatnonzero((some[ends] > some[starts]) & (n_letters > 0)):
        out.append((int(text_of[k]), bytes(c.data[starts[k] : ends[k]]).decode(errors="ignore").lower(), False))
    # words of one letter (or imitation), three or more in a row
    single = (ends - starts == 1) & (letter[starts] | leet[starts])
    first = single.copy()
    first[1:] &= ~(single[:-1] & (text_of[1:] == text_of[:-1]))
    last = single.copy()
    last[:-1] &= ~(single[1:] & (text_of[1:] == text_of[:-1]))
    for a, b in zip(np.flatnonzero(first), np.flatnonzero(last) + 1, strict=True):
        if b - a >= 3:
            out.append((int(text_of[a]), bytes(c.data[starts[a:b]]).decode().lower(), True))
    # letters joined by dots, dashes and the like
    for k in np.flatnonzero((n_letters >= 3) & (ends - starts >= 2 * n_letters - 1)):
        word = bytes(c.data[starts[k] : ends[k]]).decode(errors="ignore").lower()
        if re.fullmatch(r"[a-z0-9@$!|+]([-._*][a-z0-9@$!|+]){2,}[-._*,;:!?]?", word):
            out.append((int(text_of[k]), re.sub(r"[-._*,;:?]", "", word), True))
    return out


class Decoder:
    """Decodes stretches; equal ones once a task, as far as memory for them is set aside."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.known, self.chars = cost.tolist(), {}, 0

    def __call__(self, stretch: str, spaced: bool) -> str:
        key = (stretch, spaced)
        if key not in self.known:
            if len(self.known) > 200_000 or self.chars > KEPT_CHARS:
                self.known.clear()
                self.chars = 0
            self.known[key] = decode(stretch, self.cost, spaced)
            self.chars += len(stretch) + len(self.known[key])
        return self.known[key]


def features(c: Chunk) -> np.ndarray:
    """Hashes of each word's features, words x (1 + beginnings); 0 where a word is no longer than a beginning."""
    starts, ends = c.spans
    out = np.zeros((len(starts), 1 + len(BEGINNINGS)), dtype=np.uint64)
    out[:, 0] = c.word_hashes
    for k, size in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(ends - starts > size)
        out[long, k] = mix(c.hashes(starts[long], starts[long] + size) + np.uint64(size))
    return out


def document_features(c: Chunk, plain: Chunk, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Text index and features of all words, own and restored. plain: the chunk by white space."""
    text, found = c.text_of_word, features(c)
    restored: dict[tuple[int, str], None] = {}
    for i, stretch, spaced in stretches(plain):
        for word in decoder(stretch, spaced).split():
            restored[i, word] = None
        if spaced:
            restored[i, stretch] = None
    if restored:
        more = [(np.full(len(r.word_hashes), -1), features(r), r) for r in chunks(pa.array([w for _, w in restored]), ALNUM, lower=True, limit=1 << 40)]
        owner = np.array([i for i, _ in restored])
        text = np.concatenate([text, *[owner[r.lo : r.hi][r.text_of_word] for _, _, r in more]])
        found = np.concatenate([found, *[f for _, f, _ in more]])
    return text, found


def both(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[Chunk, Chunk]]:
    for c in chunks(column(batch, text_col), ALNUM, lower=True):
        yield c, Chunk(c.lo, c.hi, c.data, c.offsets, NOT_SPACE)


def feature_counts(labelled: DataFrame, text_col: str, toxic_col: str, cost: object) -> DataFrame:
    """feature, n_toxic, n: texts that hold a feature, over all labelled rows given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(cost.value)
        for whole in batches:
            for batch in pieces(whole, text_col):
                toxic = np.asarray(column(batch, toxic_col).to_numpy(zero_copy_only=False), dtype=np.int64)
                for c, plain in both(batch, text_col):
                    text, found = document_features(c, plain, decoder)
                    each = np.repeat(text, found.shape[1])
                    flat = found.ravel()
                    each, flat = each[flat != 0], flat[flat != 0]
                    _, one = np.unique(mix(flat + each.astype(np.uint64)), return_index=True)
                    kinds, of = np.unique(flat[one], return_inverse=True)
                    bad = np.bincount(of, weights=toxic[c.lo : c.hi][each[one]], minlength=len(kinds)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(bad), pa.array(np.bincount(of, minlength=len(kinds)).astype(np.int64))], names=["feature", "n_toxic", "n"])

    return labelled.select(text_col, toxic_col).mapInArrow(run, "feature long, n_toxic long, n long").groupBy("feature").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))


@dataclass
class Model:
    cost: np.ndarray
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0


def wholes(texts: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The columns to keep and a hash of the whole text of each row; texts that are equal but for A-Z and white space
    share it, and have the same features."""

    def make() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            out = [whole_hashes(c).view(np.int64) for c in chunks(column(batch, text_col), NOT_SPACE, lower=True)]
            return {"whole": np.concatenate(out) if out else np.zeros(0, np.int64)}

        return work

    return add_columns(texts, keep, text_col, make, T.StructType([T.StructField("whole", T.LongType())]))


def credits(toxic: DataFrame, text_col: str, model: Model, weight: np.ndarray) -> DataFrame:
    """feature, n: toxic texts in which a feature is among the weightiest ones. The words that merely
    stand beside a toxic word get none."""
    shared = toxic.sparkSession.sparkContext.broadcast((model, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weight = shared.value
        decoder = Decoder(model.cost)
        total = np.zeros(len(weight), dtype=np.int64)
        for whole in batches:
            for batch in pieces(whole, text_col):
                for c, plain in both(batch, text_col):
                    text, found = document_features(c, plain, decoder)
                    each, flat = np.repeat(text, found.shape[1]), found.ravel()
                    at = np.flatnonzero(member(flat, model.features))
                    pairs = np.unique(each[at] * len(weight) + np.searchsorted(model.features, flat[at]))
                    own, k = pairs // len(weight), pairs % len(weight)
                    best = np.zeros(c.hi - c.lo)
                    np.maximum.at(best, own, weight[k])
                    total += np.bincount(k[weight[k] >= CREDITED * best[own]], minlength=len(weight))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(model.features[at].view(np.int64)), pa.array(total[at])], names=["feature", "n"])

    return toxic.select(text_col).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def bounded(known: DataFrame, id_col: str, most: int) -> DataFrame:
    """known, or about `most` of its rows, whichever its hash of the id picks."""
    n = known.count()
    return known if n <= most else known.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) < int(most / n * 2**32))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """The character model over all documents and the classifier from the labels that are not held out, or from about `most` of them."""
    small_batches(docs)
    cost = language_model(trigrams(docs, text_col))
    named = labels.select(labels[id_col].alias("_id"), labels[toxic_col].alias("_toxic")).dropna().filter(F.col("_toxic").isin(0, 1)).filter(~held_out(F.col("_id"))).distinct()
    known = bounded(cut(named), "_id", most)
    texts = docs.filter(~held_out(docs[id_col])).select(docs[id_col].alias("_doc"), docs[text_col].alias("_text"))
    # of the copies of a whole text one teaches, or else what one text says would look like a rule; the
    # broadcast has `most` ids at most, so that no text is shuffled
    taught = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id"))
    one = wholes(taught, ["_id", "_toxic"], "_text").groupBy("whole", "_toxic").agg(F.min("_id").alias("_id"))
    kept = cut(one.select("_id", "_toxic").distinct())
    labelled = texts.join(F.broadcast(kept), F.col("_doc") == F.col("_id")).select("_text", "_toxic")
    overall = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("bad")).first()
    if not overall.bad or overall.bad == overall.n:
        return Model(cost, base=float(overall.bad > 0))
    n, bad = float(overall.n), float(overall.bad)
    counts = feature_counts(labelled, "_text", "_toxic", docs.sparkSession.sparkContext.broadcast(cost)).filter("n > 1")
    counts = cut(counts)
    tried = counts.count()
    # G squared of (toxic or not) x (feature or not), for features commoner in toxic texts
    a, b = F.col("n_toxic").cast("double"), F.col("n").cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g2 = 2 * (part(a, b * bad / n) + part(b - a, b * (n - bad) / n) + part(bad - a, (n - b) * bad / n) + part(n - bad - (b - a), (n - b) * (n - bad) / n))
    chance = (a + PRIOR_TEXTS * bad / n) / (b + PRIOR_TEXTS)
    likely = counts.filter(chance >= LEAST_CHANCE).withColumn("g2", g2).filter(F.col("g2") >= 2 * np.log(max(tried, 1)) - SLACK)
    rows = likely.toArrow()
    order = np.argsort(rows["feature"].to_numpy().view(np.uint64))
    names = rows["feature"].to_numpy().view(np.uint64)[order]
    chances = ((rows["n_toxic"].to_numpy() + PRIOR_TEXTS * bad / n) / (rows["n"].to_numpy() + PRIOR_TEXTS))[order]
    model = Model(cost, names, chances, bad / n)
    if not len(names):
        return model
    toxic = texts.join(F.broadcast(kept.filter("_toxic = 1")), F.col("_doc") == F.col("_id"))
    credited = credits(toxic, "_text", model, rows["g2"].to_numpy()[order]).toArrow()
    kept_names = credited.filter(pa.compute.greater_equal(credited["n"], LEAST_CREDIT))["feature"].to_numpy().view(np.uint64)
    at = np.flatnonzero(np.isin(names, kept_names))
    return Model(cost, names[at], chances[at], bad / n)


def score_chunk(model: Model, c: Chunk, plain: Chunk, decoder: Decoder) -> np.ndarray:
    """The chance that a text has a toxic word: one less the chances that its different words are not."""
    text, found = document_features(c, plain, decoder)
    out = np.zeros(c.hi - c.lo)
    if not len(model.features):
        return out + model.base
    best = np.zeros(len(text))
    for k in range(found.shape[1]):
        at = np.flatnonzero(member(found[:, k], model.features))
        best[at] = np.maximum(best[at], model.chance[np.searchsorted(model.features, found[at, k])])
    at = np.flatnonzero(best > model.base)
    _, one = np.unique(mix(found[at, 0] + text[at].astype(np.uint64)), return_index=True)
    at = at[one]
    np.add.at(out, text[at], np.log1p(-np.minimum(best[at], 1 - 1e-9)))
    return -np.expm1(out)


def score(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """The id columns, score and prediction of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # K**3 costs and the significant features of MOST_LABELLED texts

    def make() -> Callable[[pa.RecordBatch], dict[str, object]]:
        decoder = Decoder(shared.value.cost)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            found = [score_chunk(shared.value, c, plain, decoder) for c, plain in both(batch, text_col)]
            scores = np.concatenate(found) if found else np.zeros(0)
            return {"score": pa.array(scores), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32))}

        return work

    return add_columns(docs, id_cols, text_col, make, SCORED)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """Learns from the labels that are not held out and scores every document."""
    slim = docs.select(docs[id_col], docs[text_col], held_out(docs[id_col]).alias("held_out"))
    return score(slim, fit(docs, labels, id_col, text_col, toxic_col), [id_col, "held_out"], text_col)

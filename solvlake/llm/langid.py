"""Language identification as multilingual mixture inference.

Every language has a distribution of hashed four-byte n-grams, counted over all training documents.
A document is a mixture of languages: expectation-maximisation estimates its proportions from the
n-gram likelihoods, and of the sets of its one, two, ... most present languages the one with the best
penalised likelihood is taken. The prediction is the most present language of that set, and its share
the score: among the set, or among all languages if it is alone.

Rows and values, case by case:
- null text, or text without a letter: `und`, score 0, no languages; so is all text if nothing was learned.
- rows with null text, null language or null id teach nothing; a null id is not held out.
- ties between languages: the one first in alphabetical order. Empty tables: no rows.
- repeated rows: each is predicted for itself (and teaches as often as it stands there).
- very long texts: all their n-grams count, in chunks of whole texts. Further columns: ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvlake.llm.arrow import add_columns, column, pieces, small_batches
from solvlake.llm.words import NOT_SPACE, Chunk, byte_class, chunks

FOLDS, HELD_OUT = 3, 1
BUCKETS = 1 << 16
#: Added to every count.
SMOOTH = 0.05
ROUNDS = 12
#: Cost of a further language in log likelihood, for each unit of log(number of n-grams); n-grams
#: overlap four times, so each counts for a quarter.
PENALTY, OVERLAP = 2.0, 4.0
UNKNOWN = "und"
#: The model is collected: this many languages of BUCKETS numbers at most.
MOST_LANGUAGES = 512

_LETTER = byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[_LETTER] = np.flatnonzero(_LETTER)
_FOLD[0x41:0x5B] += 32

PREDICTED = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    + [T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType()))]
)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of every n-gram of the chunk; texts are padded with spaces."""
    n = np.diff(c.offsets)
    text = np.repeat(np.arange(len(n)), n)
    start = c.offsets[:-1] + 4 * np.arange(len(n)) + 2
    padded = np.full(len(c.data) + 4 * len(n), 32, dtype=np.uint8)
    padded[np.arange(len(c.data)) + 4 * text + 2] = _FOLD[c.data]
    owner = np.repeat(np.arange(len(n)), n + 4)
    four = np.zeros(max(len(padded) - 3, 0), dtype=np.uint32)
    for k in range(4):
        four |= padded[k : k + len(four)].astype(np.uint32) << np.uint32(8 * k)
    last = np.repeat(start + n + 2, n + 4)  # end of each padded text
    place = np.arange(len(four))
    good = (place + 4 <= last[: len(four)]) & ~((padded[: len(four)] == 32) & (padded[1 : len(four) + 1] == 32))
    good &= (padded[1 : len(four) + 1] != 32) | (padded[2 : len(four) + 2] != 32)
    bucket = (four[good] * np.uint32(2654435761)) >> np.uint32(16)
    return owner[: len(four)][good], bucket


def learn(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, bucket, n: n-gram counts by language over all rows given."""
    schema = "lang string, bucket int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in pieces(whole, text_col):
                named = column(batch, lang_col).to_pylist()
                order = sorted(set(named))
                code = np.array([order.index(x) for x in named], dtype=np.int64)
                for c in chunks(column(batch, text_col), NOT_SPACE):
                    text, bucket = grams(c)
                    found = np.bincount(code[c.lo : c.hi][text] * BUCKETS + bucket, minlength=len(order) * BUCKETS).reshape(len(order), BUCKETS)
                    for k, name in enumerate(order):
                        if name not in total:
                            total[name] = np.zeros(BUCKETS, dtype=np.int64)
                        total[name] += found[k]
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return docs.select(text_col, lang_col).mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    names: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from the rows that are not held out."""
    small_batches(docs)
    known = docs.filter(~held_out(docs[id_col]) & docs[id_col].isNotNull() & docs[text_col].isNotNull() & docs[lang_col].isNotNull())
    # blocks of 1024 buckets as one row, so that the driver gets few rows
    packed = learn(known, text_col, lang_col).groupBy("lang", F.shiftright("bucket", 10)).agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    rows = packed.toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.full((BUCKETS, len(names)), SMOOTH)
    for i, name in enumerate(rows["lang"].to_pylist()):
        counts[np.asarray(rows["bucket"][i].values), names.index(name)] += np.asarray(rows["n"][i].values)
    return Model(names, np.log(counts / counts.sum(axis=0, keepdims=True)) if names else counts)


def mixtures(p: np.ndarray, n: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document; p: likelihood of its n-grams by language, n: how
    often each occurs, first: where each document's n-grams begin, allowed: languages of each document."""
    size = np.diff(np.append(first, len(n)))
    share = allowed / allowed.sum(axis=1, keepdims=True)
    total = np.add.reduceat(n, first)
    for _ in range(rounds):
        joint = p * np.repeat(share, size, axis=0)
        share = np.add.reduceat(joint * (n / joint.sum(axis=1))[:, None], first, axis=0) / total[:, None]
    joint = (p * np.repeat(share, size, axis=0)).sum(axis=1)
    return share, np.add.reduceat(n * np.log(joint), first)


def infer(model: Model, p: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen language set of each document (as a mask) and the proportions in it."""
    docs, langs = len(first), len(model.names)
    size = np.diff(np.append(first, len(n)))
    alone = np.add.reduceat(np.log(p) * n[:, None], first, axis=0)
    chosen = np.arange(langs) == np.argmax(alone, axis=1)[:, None]
    share = chosen.astype(float)
    if langs == 1:
        return chosen, share
    every, best = mixtures(p, n, first, np.ones((docs, langs)))
    cost = PENALTY * np.log(np.maximum(np.add.reduceat(n, first), 2))
    value = alone.max(axis=1) / OVERLAP
    share = every
    rank = np.argsort(np.argsort(-every, axis=1, kind="stable"), axis=1, kind="stable")
    for k in range(2, langs + 1):
        # no set of k can gain more than all languages do
        open_ = np.flatnonzero(best / OVERLAP - (k - 1) * cost > value)
        if not len(open_):
            break
        mask = np.zeros(docs, dtype=bool)
        mask[open_] = True
        own = np.repeat(mask, size)
        start = np.concatenate([[0], np.cumsum(size[open_])[:-1]])
        part, likelihood = mixtures(p[own], n[own], start, (rank[open_] < k).astype(float))
        gain = likelihood / OVERLAP - (k - 1) * cost[open_]
        won = gain > value[open_]
        at = open_[won]
        value[at], chosen[at], share[at] = gain[won], rank[at] < k, part[won]
    return chosen, share


def lettered(c: Chunk) -> np.ndarray:
    """Whether each text has a letter."""
    plain = byte_class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
    has = c.sums_by_text(plain[c.data]) > 0
    for i in np.flatnonzero(~has & (c.sums_by_text(c.data >= 0x80) > 0)):
        has[i] = any(x.isalpha() for x in bytes(c.data[c.offsets[i] : c.offsets[i + 1]]).decode())
    return has


def predict_chunk(model: Model, c: Chunk) -> list[tuple[str, float, list[str], list[float]]]:
    out: list[tuple[str, float, list[str], list[float]]] = [(UNKNOWN, 0.0, [], [])] * (c.hi - c.lo)
    text, bucket = grams(c)
    has = lettered(c)
    key, n = np.unique(text.astype(np.int64) * BUCKETS + bucket, return_counts=True)
    key, n = key[has[key // BUCKETS]], n[has[key // BUCKETS]].astype(float)
    if not len(key) or not model.names:
        return out
    docs, first = np.unique(key // BUCKETS, return_index=True)
    chosen, share = infer(model, np.exp(model.log_p[key % BUCKETS]), n, first)
    for i, doc in enumerate(docs):
        kept = np.where(chosen[i], share[i], 0.0)
        order = [int(k) for k in np.argsort(-kept, kind="stable") if chosen[i][k]]
        out[int(doc)] = (model.names[order[0]], float(min(1.0, kept[order[0]])), [model.names[k] for k in order], [float(kept[k]) for k in order])
    return out


def predict(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """The id columns, lang_pred, score, and the language set with its proportions, for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_LANGUAGES columns

    def make() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            rows = [r for c in chunks(column(batch, text_col), NOT_SPACE, limit=1 << 20) for r in predict_chunk(shared.value, c)]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            return {f.name: pa.array([r[k] for r in rows], kinds[k]) for k, f in enumerate(PREDICTED.fields)}

        return work

    return add_columns(docs, id_cols, text_col, make, PREDICTED)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    slim = docs.select(docs[id_col], docs[text_col], held_out(docs[id_col]).alias("held_out"))
    return predict(slim, fit(docs, id_col, text_col, lang_col), [id_col, "held_out"], text_col)

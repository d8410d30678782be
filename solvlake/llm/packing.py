"""Conflict-constrained best-fit packing.

Documents become pieces of at most `capacity` tokens: full ones, and a rest. Pieces are packed, longest
first, each into the tightest open bin that it may enter. Bins are ordered by residual; each carries a
bitmap of its sources (so many bits a source as pieces of it may share a bin) and a bitmap of its
duplicate clusters. The search starts at the smallest residual that fits and goes on to its successor
until a compatible bin is found; a piece that fits nowhere opens a bin.

Pieces are dealt by a hash of all that they have to as many blocks as give each about `block` pieces, and
a block is packed on its own: the blocks, and so the bins, follow from the rows alone, however they are
partitioned. A hot source or cluster is spread over all blocks, and only lengths, sources and clusters
move. A block leaves a tail of bins that a larger one could fill, which `block` sets the price of.

Tokens are those of a byte-level BPE vocabulary, or words between white space where `tokenizer` is None.

Rows and values, case by case:
- null or empty text: a piece of 0 tokens, which fits any compatible bin. Null source: a source of its own.
- null id: kept. Texts longer than a bin: several pieces, in order; nothing is cut off.
- ties: equal lengths go by cluster, piece, id, source and text hash; equal residuals by age of the bin.
- repeated rows: packed like copies, never into one bin; which of them is which makes no difference.
- empty table: no rows. Further columns: ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvlake.llm.arrow import add_columns, column, pieces as slices, small_batches
from solvlake.llm.shared import written
from solvlake.llm.tokens import TOKENIZER, encoder, vocabulary, version_of
from solvlake.llm.words import NOT_SPACE, chunks, whole_hashes

CAPACITY = 2048
#: Pieces of one source that may share a bin.
SOURCE_SLOTS = 4
#: Pieces of a block, about.
BLOCK = 8192
#: Copies of one row that are dealt from one place.
SPREAD = 4096

PACKED = "{id} {kind}, text_key long, piece int, n_tokens long, start long, bin string, bin_tokens long, bin_pieces int"
OUT = ["piece", "n_tokens", "start", "bin", "bin_tokens", "bin_pieces"]


class Bins:
    """Open bins by residual."""

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots = capacity, slots
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0  # bit r: there are bins of residual r
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _first_free(self, bits: int, source: int) -> int:
        """The bit of the source's first free slot, or 0."""
        for k in range(self.slots):
            if not bits >> (source * self.slots + k) & 1:
                return 1 << (source * self.slots + k)
        return 0

    def put(self, size: int, source: int, cluster: int) -> int:
        """The bin that a piece goes to; cluster: the bit of its cluster, or 0."""
        rest, mine = self.some >> size, cluster
        residual = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual, rest = residual + step, rest >> step
            for k, b in enumerate(self.at[residual]):
                if not self.clusters[b] & mine and (slot := self._first_free(self.sources[b], source)):
                    del self.at[residual][k]
                    if not self.at[residual]:
                        self.some &= ~(1 << residual)
                    self._open(b, residual - size, slot, mine)
                    return b
            residual, rest = residual + 1, rest >> 1
        b = len(self.sources)
        self.sources.append(0)
        self.clusters.append(0)
        self._open(b, self.capacity - size, 1 << (source * self.slots), mine)
        return b

    def _open(self, b: int, residual: int, slot: int, mine: int) -> None:
        self.sources[b] |= slot
        self.clusters[b] |= mine
        self.at[residual].append(b)
        self.some |= 1 << residual


def best_fit(sizes: np.ndarray, sources: list, clusters: np.ndarray, capacity: int, slots: int) -> np.ndarray:
    """The bin of each piece; pieces come in packing order. Only clusters of two pieces or more can
    conflict and have a bit."""
    kinds, of, n = np.unique(clusters, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    bit = np.full(len(kinds), -1)
    bit[shared] = np.arange(len(shared))
    names = {s: k for k, s in enumerate(dict.fromkeys(sources))}
    bins = Bins(capacity, slots)
    out = np.zeros(len(sizes), dtype=np.int64)
    for i, (size, source, c) in enumerate(zip(sizes.tolist(), sources, bit[of].tolist(), strict=True)):
        out[i] = bins.put(size, names[source], 1 << c if c >= 0 else 0)
    return out


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].alias("text"))


def _clusters(batch: pa.RecordBatch) -> np.ndarray:
    """Duplicate cluster of each text: texts that are equal but for A-Z and white space share it."""
    found = [whole_hashes(c) for c in chunks(column(batch, "text"), NOT_SPACE, lower=True)]
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)


def sized(slim: DataFrame, tokenizer: str | None) -> DataFrame:
    """id, source, text_key, cluster, n (tokens) of each row."""
    ranks = None if tokenizer is None else slim.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))  # a vocabulary file, about a megabyte

    def make() -> Callable[[pa.RecordBatch], dict[str, object]]:
        if ranks is None:
            count = lambda texts: np.concatenate([np.diff(c.first_word) for c in chunks(texts, NOT_SPACE)]) if len(texts) else np.zeros(0, np.int64)
        else:
            encode = encoder(ranks.value, version_of(tokenizer))
            count = lambda texts: np.array([len(encode(t.as_py() or "")) for t in texts], dtype=np.int64)
        return lambda batch: {"cluster": _clusters(batch), "n": count(column(batch, "text"))}

    return add_columns(slim, ["id", "source", "text_key"], "text", make, T.StructType([T.StructField("cluster", T.LongType()), T.StructField("n", T.LongType())]))


def _pieces(rows: DataFrame, capacity: int) -> DataFrame:
    """A row for each piece of the rows of sized(): nth piece, and n, its tokens."""
    last = F.greatest(F.floor((F.col("n") - 1) / capacity), F.lit(0)).cast("int")
    each = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return each.withColumn("n", F.least(F.col("n") - F.col("piece").cast("long") * capacity, F.lit(capacity).cast("long")))


def _dealt(pieces: DataFrame, block: int) -> DataFrame:
    """The pieces with their block, by block. Equal rows are counted, and dealt by their number."""
    names = pieces.columns
    total = pieces.count()
    blocks = max(1, -(-total // block))
    counted = pieces.groupBy(*names).agg(F.count("*").alias("copies"))
    many = counted.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / SPREAD))))
    spread = many.repartition(F.xxhash64(*names, "k"))
    each = spread.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("copies") - F.col("k") * SPREAD, F.lit(SPREAD)) - 1)))
    numbered = each.withColumn("block", F.pmod(F.xxhash64(*names, "k", "copy"), F.lit(blocks)))
    parts = min(blocks, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a task packs its blocks one after another
    return numbered.select(*names, "block").repartition(parts, "block").sortWithinPartitions("block")


def packed(t: pa.Table, name: str, id_col: str, capacity: int, slots: int) -> pa.Table:
    """The bins of one block."""
    t = t.sort_by([("n", "descending"), ("cluster", "ascending"), ("piece", "ascending"), ("id", "ascending"), ("source", "ascending"), ("text_key", "ascending")])
    n, piece = t["n"].to_numpy(), t["piece"].to_numpy()
    bins = best_fit(n, t["source"].to_pylist(), t["cluster"].to_numpy(), capacity, slots)
    filled, count = np.bincount(bins, weights=n).astype(np.int64), np.bincount(bins)
    return pa.table(
        {
            id_col: t["id"],
            "text_key": t["text_key"],
            "piece": pa.array(piece, pa.int32()),
            "n_tokens": pa.array(n),
            "start": pa.array(piece.astype(np.int64) * capacity),
            "bin": pa.array([f"{name}-{b}" for b in bins.tolist()], pa.string()),
            "bin_tokens": pa.array(filled[bins]),
            "bin_pieces": pa.array(count[bins], pa.int32()),
        }
    )


def _binned(pieces: DataFrame, id_col: str, capacity: int, slots: int, block: int) -> DataFrame:
    kind = pieces.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from packed(pa.Table.from_batches(held), str(column(held[0], "block")[0].as_py()), id_col, capacity, slots).combine_chunks().to_batches()
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = column(batch, "block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and column(held[0], "block")[0].as_py() != numbers[a]:
                    yield from flush()
                held.append(batch.slice(a, b - a))
        yield from flush()

    return _dealt(pieces, block).mapInArrow(run, PACKED.format(id=f"`{id_col}`", kind=kind))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, slots: int = SOURCE_SLOTS, block: int = BLOCK, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """A row for each piece: id, piece, tokens, first token in the text, bin, and the bin's tokens and pieces."""
    rows = written(sized(_slim(docs, id_col, text_col, source_col), tokenizer), "packing-sizes")
    return _binned(_pieces(rows, capacity), id_col, capacity, slots, block).select(F.col(f"`{id_col}`"), *OUT)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, slots: int = SOURCE_SLOTS, block: int = BLOCK, tokenizer: str = TOKENIZER) -> DataFrame:
    """The rows of pack() with `tokens`, the piece's token ids; the pieces of a bin are a training sequence.
    A text is tokenised once, and its tokens are shuffled once, to their bins' rows."""
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))  # a vocabulary file, about a megabyte
    slim = _slim(docs, id_col, text_col, source_col)
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, version_of(tokenizer))
        for batch in (part for whole in batches for part in slices(whole, "text")):
            clusters, texts = _clusters(batch), column(batch, "text")
            for at in range(0, batch.num_rows, 256):
                ids = [np.asarray(encode(t.as_py() or ""), dtype=np.int32) for t in texts.slice(at, 256)]
                own = [(at + i, p, x[p * capacity : (p + 1) * capacity]) for i, x in enumerate(ids) for p in range(max(1, -(-len(x) // capacity)))]
                row = pa.array([i for i, _, _ in own], pa.int64())
                ends = np.cumsum([0, *(len(x) for _, _, x in own)])
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x for _, _, x in own]) if own else np.zeros(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, c).take(row) for c in ("id", "source", "text_key")] + [pa.array(clusters).take(row), pa.array(np.diff(ends)), pa.array([p for _, p, _ in own], pa.int32()), tokens],
                    names=["id", "source", "text_key", "cluster", "n", "piece", "tokens"],
                )
        pa.default_memory_pool().release_unused()

    small_batches(docs)
    pieces = written(slim.mapInArrow(run, f"id {kind}, source string, text_key long, cluster long, n long, piece int, tokens array<int>"), "packing-tokens")
    bins = _binned(pieces.drop("tokens"), id_col, capacity, slots, block)
    key = lambda c: F.struct(F.col(c).alias("id"), "text_key", "piece").alias("key")
    one = pieces.select(key("id"), "tokens").groupBy("key").agg(F.first("tokens").alias("tokens"))
    return bins.withColumn("key", key(f"`{id_col}`")).join(one, "key").select(F.col(f"`{id_col}`"), *OUT, "tokens")

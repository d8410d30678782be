"""Benchmark decontamination with suffix arrays of the training text.

The training documents are worked through in shards (chunks of whole texts). A shard's suffix array
holds, in the order of the word sequences that start there, every suffix that can begin a match: one
whose leading word runs all occur somewhere in the benchmark; any other suffix differs from every
test suffix within its first window. Each test suffix is searched in it by bisection, which gives the
longest verbatim match and all its places. Nothing is shuffled: a document is in one shard, and the
benchmark's suffixes go to the executors in blocks of bounded size, read one at a time.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. A window is `window` consecutive
words of an item, or the whole item if it has fewer.

Rows and values, case by case:
- null or empty text: no words, no hits, not contaminated. Items without words have no window.
- an item id that is null counts as an item named "null"; rows that repeat an item id are one item.
- repeated document rows: a result row each. Empty documents: no rows. Empty benchmark: no hits.
- ties: the longest match is the one at the first place, there with the item whose id is first as a string.
- further columns: ignored by match(), carried along unchanged by remove().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvlake.llm.arrow import add_columns, column, keep_rows
from solvlake.llm.words import ALNUM, Chunk, chunks, inside, window_hashes

WINDOW = 10
GRAM = 4
#: Bytes of training text in one shard: every test suffix is searched in each.
SHARD_BYTES = 3 << 20
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 4 << 20
#: Words of a suffix that are kept for comparison; matches that are longer are followed from suffix to suffix.
DEPTH = 32

FOUND = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType())]
    + [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    + [T.StructField("longest", T.LongType()), T.StructField("longest_at", T.LongType()), T.StructField("longest_item", T.StringType())]
)


@dataclass
class Block:
    """Test suffixes of some items: vocabulary, leading grams, and the windows in order of content."""

    vocabulary: np.ndarray
    grams: np.ndarray
    gram: int
    shortest: int
    depth: int
    queries: np.ndarray  # a row of word ids (big-endian, 0 past the end) for each distinct test suffix
    lengths: np.ndarray  # words of its window
    names: list[list[str]]  # items it stands in
    long_first: np.ndarray  # where each query's entries begin in the next two arrays
    long_at: np.ndarray  # places in the items, one after another, that have depth words left or more
    long_item: np.ndarray  # the item of each, as its index in item_names
    item_names: list[str]  # sorted
    name_rank: np.ndarray  # of each query, its first item's index in item_names


def rows_of(ids: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Word ids from each place on, up to its text's end, as rows of depth."""
    grid = at[:, None] + np.arange(depth)
    return np.where(grid < end[:, None], ids[np.minimum(grid, max(len(ids) - 1, 0))], 0).astype(">u4")


def as_keys(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1] * 4}").ravel()


def block(items: list[tuple[str, str | None]], window: int) -> Block | None:
    """The search structure of some items; None if they have no words."""
    texts = pa.array([t for _, t in items], pa.large_string())
    parts = list(chunks(texts, ALNUM, lower=True, limit=1 << 40))
    if not parts or not len(parts[0].word_hashes):
        return None
    c = parts[0]
    words, first = c.word_hashes, c.first_word
    n = np.diff(first)
    size = np.minimum(n, window)
    shortest = int(size[n > 0].min())
    gram = min(GRAM, shortest)
    vocabulary = np.unique(words)
    ids = np.searchsorted(vocabulary, words) + 1
    starts = np.concatenate([np.arange(a, b - s + 1) for a, b, s in zip(first[:-1], first[1:], size, strict=True) if s])
    item = np.concatenate([np.full(k - s + 1, i) for i, (k, s) in enumerate(zip(n, size, strict=True)) if s])
    depth = int(min(max(n.max(), window), max(DEPTH, window)))
    rows = rows_of(ids, starts, first[1:][item], depth)
    kinds = np.concatenate([rows, size[item][:, None].astype(">u4")], axis=1)
    _, one, of = np.unique(as_keys(kinds), return_index=True, return_inverse=True)
    names: list[set[str]] = [set() for _ in one]
    for k, i in zip(of, item, strict=True):
        names[k].add(items[i][0])
    grams = np.unique(window_hashes(words, gram)[inside(first, len(words), gram)])
    item_names = sorted({name for name, _ in items})
    number = {name: k for k, name in enumerate(item_names)}
    long = np.flatnonzero(first[1:][item] - starts >= depth)
    long = long[np.argsort(of[long], kind="stable")]
    long_first = np.searchsorted(of[long], np.arange(len(one) + 1))
    # the item is added so that an item's last place is not followed by the next one's first
    long_at, long_item = (starts + item)[long], np.array([number[items[i][0]] for i in item[long]], dtype=np.int64)
    return Block(vocabulary, grams, gram, shortest, depth, rows[one], size[item][one], [sorted(x) for x in names], long_first, long_at, long_item, item_names, np.array([number[min(x)] for x in names], dtype=np.int64))


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted table."""
    fits = np.zeros(1 << 18, dtype=bool)
    fits[(table >> np.uint64(46)).astype(np.int64)] = True
    out = fits[(values >> np.uint64(46)).astype(np.int64)]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(table, values[at]), len(table) - 1)
    out[at] = table[place] == values[at]
    return out


class Shard:
    """The suffix array of a chunk for one block."""

    def __init__(self, c: Chunk, b: Block):
        words, first = c.word_hashes, c.first_word
        self.places = np.zeros(0, np.int64)
        if not len(words):
            return
        ok = np.zeros(len(words), dtype=bool)
        hashes = window_hashes(words, b.gram)
        ok[: len(hashes)] = member(hashes, b.grams) & inside(first, len(words), b.gram) if len(hashes) else False
        need = b.shortest - b.gram + 1
        run = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(ok, out=run[1:])
        at = np.flatnonzero(ok[: len(words) - need + 1])
        at = at[run[at + need] - run[at] == need]
        at = at[c.first_word[1:][c.text_of_word[at]] - at >= b.shortest]
        if not len(at):
            return
        end = first[1:][c.text_of_word[at]]
        # only the words that these suffixes reach need an id
        near = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(near, at, 1)
        np.add.at(near, np.minimum(at + b.depth, end), -1)
        used = np.flatnonzero(np.cumsum(near)[:-1])
        ids = np.zeros(len(words), dtype=np.int64)
        place = np.minimum(np.searchsorted(b.vocabulary, words[used]), len(b.vocabulary) - 1)
        ids[used] = np.where(b.vocabulary[place] == words[used], place + 1, 0)
        rows = rows_of(ids, at, end, b.depth)
        order = np.argsort(as_keys(rows), kind="stable")
        self.places, self.rows = at[order], rows[order]
        self.keys = as_keys(self.rows)

    def search(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, str]]:
        """Query, place and match length of every occurrence of a test suffix's window, and by place the
        item with the longest match where that has more words than a row."""
        if not len(self.places):
            return (*(np.zeros(0, np.int64),) * 3, {})
        past = np.arange(b.depth) >= b.lengths[:, None]
        lo = np.searchsorted(self.keys, as_keys(np.where(past, 0, b.queries).astype(">u4")), "left")
        hi = np.searchsorted(self.keys, as_keys(np.where(past, 0xFFFFFFFF, b.queries).astype(">u4")), "right")
        n = hi - lo
        query = np.repeat(np.arange(len(n)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        length = np.zeros(len(row), dtype=np.int64)
        for a in range(0, len(row), 1 << 16):
            s = slice(a, a + (1 << 16))
            same = (self.rows[row[s]] == b.queries[query[s]]) & (b.queries[query[s]] != 0)
            length[s] = np.where(same.all(axis=1), b.depth, np.argmin(same, axis=1))
        return query, self.places[row], length, self.follow(b, query, self.places[row], length)

    def follow(self, b: Block, query: np.ndarray, place: np.ndarray, length: np.ndarray) -> dict[int, str]:
        """Puts the true length where a whole row is equal. Such a match has as many words more as there
        are such matches in the next places of both the text and the item."""
        full = np.flatnonzero((length == b.depth) & (np.diff(b.long_first)[query] > 0))
        items: dict[int, str] = {}
        if not len(full):
            return items
        # for each place in the items, how many matches follow the match with the text's last place seen
        after = np.zeros(int(b.long_at.max()) + 2, dtype=np.int64)
        last, seen = -1, np.zeros(0, np.int64)
        for k in full[np.argsort(-place[full], kind="stable")]:
            entries = slice(b.long_first[query[k]], b.long_first[query[k] + 1])
            at = b.long_at[entries]
            found = after[at + 1] + 1 if place[k] + 1 == last else np.ones(len(at), np.int64)
            after[seen], after[at] = 0, found
            last, seen = int(place[k]), at
            most = found.max()
            length[k] = b.depth + most - 1
            if most > 1:
                items[last] = b.item_names[b.long_item[entries][found == most].min()]
        return items


def examine(text: str, window: int, blocks: list) -> Callable[[pa.RecordBatch], dict[str, object]]:
    """blocks: broadcast Blocks; more than one are loaded in turn."""

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {f.name: [] for f in FOUND.fields}
        for c in chunks(column(batch, text), ALNUM, lower=True, limit=SHARD_BYTES):
            texts, words = c.hi - c.lo, len(c.word_hashes)
            cover = np.zeros(words + 1, dtype=np.int64)
            names: dict[int, set[str]] = {}
            best: dict[int, tuple[int, int, str]] = {}
            for one in blocks:
                b = one.value
                query, place, length, items = Shard(c, b).search(b)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + b.lengths[query], -1)
                text_of = c.text_of_word[place]
                pairs = np.unique(text_of * len(b.names) + query)
                for i, q in zip(pairs // len(b.names), pairs % len(b.names), strict=True):
                    names.setdefault(int(i), set()).update(b.names[q])
                order = np.lexsort((b.name_rank[query], place, -length, text_of))
                _, lead = np.unique(text_of[order], return_index=True)
                for k in order[lead]:
                    i = int(text_of[k])
                    mine = (-int(length[k]), int(place[k] - c.first_word[i]), items.get(int(place[k]), b.names[query[k]][0]))
                    best[i] = min(best.get(i, mine), mine)
                if len(blocks) > 1:
                    one.unpersist_value()
            total = np.zeros(words + 1, dtype=np.int64)
            np.cumsum(np.cumsum(cover)[:-1] > 0, out=total[1:])
            hit = total[c.first_word[1:]] - total[c.first_word[:-1]]
            own = [sorted(names.get(i, ())) for i in range(texts)]
            out["n_words"] += np.diff(c.first_word).tolist()
            out["n_hit"] += hit.tolist()
            out["n_items"] += [len(x) for x in own]
            out["items_sha256"] += [hashlib.sha256(",".join(x).encode()).hexdigest() for x in own]
            out["contaminated"] += (hit > 0).tolist()
            out["longest"] += [-best[i][0] if i in best else 0 for i in range(texts)]
            out["longest_at"] += [best[i][1] if i in best else None for i in range(texts)]
            out["longest_item"] += [best[i][2] if i in best else None for i in range(texts)]
        return {f.name: pa.array(out[f.name], {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in FOUND.fields}

    return work


class Held:
    """A broadcast Block; unpersist_value() drops this process's copy, which is read again from disk when needed."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> Block:
        return self.broadcast.value

    def unpersist_value(self) -> None:
        if hasattr(self.broadcast, "_value") and getattr(self.broadcast, "_path", None):
            del self.broadcast._value


def blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list[Held]:
    """The benchmark as broadcast blocks of at most block_bytes of text each (one item at least)."""

    def parts() -> Iterator[list[tuple[str, str | None]]]:
        now, held = [], 0
        for name, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), text_col).toLocalIterator():
            size = len((text or "").encode())
            if now and held + size > block_bytes:
                yield now
                now, held = [], 0
            now.append((name, text))
            held += size
        if now:
            yield now

    return [Held(spark.sparkContext.broadcast(b)) for p in parts() if (b := block(p, window)) is not None]


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: words, hit words, items, and its longest match with place and item."""
    tests = blocks(docs.sparkSession, benchmark, item_col, item_text_col, window, block_bytes)
    return add_columns(docs, [id_col], text_col, lambda: examine(text_col, window, tests), FOUND)


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a hit, with all their columns."""
    tests = blocks(docs.sparkSession, benchmark, item_col, item_text_col, window, block_bytes)

    def make() -> Callable[[pa.RecordBatch], np.ndarray]:
        work = examine(text_col, window, tests)
        return lambda batch: ~np.asarray(work(batch)["contaminated"])

    return keep_rows(docs, text_col, make)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS row, coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT *, least(len(w), 10) AS s FROM b WHERE len(w) > 0),
windows AS (SELECT row, item, s, i, array_to_string(w[i:i + s - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM sized)),
kinds AS (SELECT DISTINCT s, t FROM windows),
starts AS (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS p FROM d, (SELECT DISTINCT s FROM sized) WHERE len(w) >= s),
hits AS (SELECT r, s, p, t FROM (SELECT r, s, p, array_to_string(w[p:p + s - 1], ' ') AS t FROM starts) SEMI JOIN kinds USING (s, t)),
met AS (SELECT r, p, s, row, item, i FROM hits JOIN windows USING (s, t)),
cover AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + s)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM met) GROUP BY r),
islands AS (SELECT *, p - row_number() OVER (PARTITION BY r, row, p - i ORDER BY p) AS island FROM met),
matches AS (SELECT r, item, min(p) AS p, count(*) + min(s) - 1 AS n FROM islands GROUP BY r, item, row, p - i, island),
best AS (SELECT r, n, p - 1 AS place, item FROM matches QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, p, item) = 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n, 0)::BIGINT AS longest, place::DOUBLE AS longest_at, item AS longest_item
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)
"""

"""Substring dedup: words covered by a window that also starts elsewhere go.

A window is `window` consecutive words of one document. Windows that are equal have equal minimizers
(the least hash of their `gram`-word stretches), so windows are dealt by minimizer: consecutive ones
with the same minimizer form a segment. Segments whose minimizer occurs once in the corpus cannot hold
a repeat. The rest are dealt to shards, each different one as often as it occurs but twice at most; each
shard builds a compressed FM-index of its segments, and matching statistics by backward search over the
wavelet matrix give the windows that occur twice or more. A minimizer with more than `crowd` different
segments is dealt window by window under the windows' own hashes, again each different window twice at
most, so that no key brings more rows to a shard than it can hold.

Texts are shuffled only where they must be: those that lend a segment to a shard, and those that lose
words. A Bloom filter picks them (and a few others), and an exact join follows.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.

Rows and values, case by case:
- null or empty text: no words, nothing removed; kept text is empty.
- null id: like any other. Repeated rows: each is an occurrence, so their windows go in all of them.
- a window that occurs twice in one document, overlapping or not, goes in both places.
- ties: none; which windows go depends on the input alone. Empty table: no rows. Very long texts: whole.
- further columns: ignored by report(), carried along unchanged by clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvlake.llm.arrow import add_columns, column, keep_rows, pieces, small_batches
from solvlake.llm.bloom import Bloom, bloom, passing
from solvlake.llm.fm_index import FMIndex, repeated_windows
from solvlake.llm.shared import written
from solvlake.llm.words import NOT_SPACE, Chunk, chunks, inside, mix, run_hashes, window_hashes

WINDOW = 35
#: Long enough that stretches which recur by chance, as short phrases do in a large corpus, are rare.
GRAM = 12
#: Different segments of a minimizer beyond which its windows are dealt one by one.
CROWD = 2048
#: Words that one shard takes, about.
SHARD_WORDS = 1 << 19

#: Columns added on the way; no document has such names.
TEXT, RUNS, KEPT = "__substrings_text", "__substrings_runs", "__substrings_kept"
TEXT_KEY, ROW, WORDS, SHA = "__substrings_text_key", "__substrings_row", "__substrings_words", "__substrings_sha"

REPORTED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def least_in(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of size values."""
    out, have = values, 1
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - size + 1], out[size - have : len(values) - have + 1]) if size > have else out


def segments_of(c: Chunk, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, first word in the text, number of windows, minimizer and content hash of every segment, and
    whether its minimizer may stand in it more than once."""
    words, first = c.word_hashes, c.first_word
    at = np.flatnonzero(inside(first, len(words), window))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    grams, span = mix(window_hashes(words, gram)), window - gram + 1
    # the least by its upper half, with its place in the lower half: its first place, and its last
    upper, place = grams & np.uint64(0xFFFFFFFF00000000), np.arange(len(grams), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    left = least_in(upper | place, span)[at] & low
    right = ~least_in(upper | (low - place), span)[at] & low
    text, key = c.text_of_word[at], grams[left]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    lead = np.flatnonzero(new)
    n = np.diff(np.append(lead, len(at)))
    start = at[lead]
    content = run_hashes(words, start, n + window - 1)
    again = np.logical_or.reduceat(left != right, lead) | (n > span)
    return text[lead], start - first[text[lead]], n, key[lead], content, again


def all_segments(slim: DataFrame, window: int, gram: int, only: Broadcast[Bloom] | None = None) -> DataFrame:
    """id, text_key, least, content, start, n, again of every segment of every row; only: of those whose
    minimizer the filter lets pass."""
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                for c in chunks(column(batch, "text"), NOT_SPACE):
                    found = segments_of(c, window, gram)
                    if only is not None:
                        some = only.value.may_hold(found[3])
                        found = tuple(x[some] for x in found)
                    text, start, n, least, content, again = found
                    row = pa.array(text + c.lo)
                    made = [pa.array(least.view(np.int64)), pa.array(content.view(np.int64)), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(again)]
                    yield pa.RecordBatch.from_arrays([column(batch, "id").take(row), column(batch, "text_key").take(row), *made], names=["id", "text_key", "least", "content", "start", "n", "again"])

    return slim.select("id", "text_key", "text").mapInArrow(run, f"id {kind}, text_key long, least long, content long, start int, n int, again boolean")


def _body(c: Chunk, first: int, words: int) -> bytes:
    starts, ends = c.spans
    return bytes(memoryview(c.data)[starts[first] : ends[first + words - 1]])


def bodies(texts: DataFrame, window: int) -> DataFrame:
    """least, content, at, window, n, copies, body: the words of each wanted segment (at: null), or those of
    each of its windows if its minimizer is crowded (at: place in the segment, window: hash)."""
    names = ["least", "content", "at", "window", "n", "copies", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def rows(c: Chunk, first: int, w: dict) -> Iterator[tuple]:
        if not w["crowded"]:
            yield w["least"], w["content"], None, None, w["n"], w["copies"], _body(c, first, w["n"] + window - 1)
            return
        hashes = window_hashes(c.word_hashes[first : first + w["n"] + window - 1], window).view(np.int64).tolist()
        for k, h in enumerate(hashes):
            yield w["least"], w["content"], k, h, 1, w["copies"], _body(c, first + k, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                wanted = column(batch, "wanted").to_pylist()
                for c in chunks(column(batch, "text"), NOT_SPACE):
                    made = [r for i in range(c.lo, c.hi) for w in wanted[i] for r in rows(c, int(c.first_word[i - c.lo]) + w["start"], w)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], names=names)

    return texts.select("text", "wanted").mapInArrow(run, "least long, content long, at int, window long, n int, copies long, body binary")


def search_shard(t: pa.Table, window: int) -> pa.Table:
    """least, content, start, n: runs of repeated windows in each segment of a shard."""
    # a segment that occurs more than once stands twice in the index
    held = np.repeat(np.arange(t.num_rows), 1 + (t["copies"].to_numpy() > 1))
    text = t["body"].combine_chunks().cast(pa.large_binary()).take(pa.array(held)).view(pa.large_string())
    c = next(chunks(text, NOT_SPACE, limit=1 << 60))
    _, ids = np.unique(c.word_hashes, return_inverse=True)
    size = np.diff(c.first_word)
    # the segments one after another, a separator before each
    starts = c.first_word[:-1] + np.arange(1, len(size) + 1)
    symbols = np.zeros(len(ids) + len(size) + 1, dtype=np.int64)
    symbols[np.arange(len(ids)) + np.repeat(np.arange(1, len(size) + 1), size)] = ids + 1
    one = np.flatnonzero(np.diff(held, prepend=-1))
    flags = repeated_windows(FMIndex(symbols, window + 2), symbols, starts[one], starts[one] + size[one], window, t["copies"].to_numpy() > 1)
    edge = np.diff(flags.astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(starts, begin, "right") - 1
    row = pa.array(held[of])
    return pa.table({"least": t["least"].take(row), "content": t["content"].take(row), "start": pa.array(begin - starts[of], pa.int32()), "n": pa.array(stop - begin, pa.int32())})


def shard_repeats(dealt: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            # a document that is there twice under one id brings its segments twice
            key = np.stack([t[x].to_numpy() for x in ("least", "content")], axis=1)
            _, one = np.unique(key, axis=0, return_index=True)
            yield from search_shard(t.take(pa.array(np.sort(one))), window).combine_chunks().to_batches()

    return dealt.mapInArrow(run, "least long, content long, start int, n int")


def repeats(slim: DataFrame, window: int, gram: int, crowd: int, shard_words: int) -> DataFrame:
    """id, text_key, runs: for each different row with repeats, its runs (first word, windows)."""
    spark = slim.sparkSession
    small_batches(slim)
    gram = min(gram, window)
    every = all_segments(slim, window, gram).groupBy("least").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("times"))
    twice = written(every.filter("times > 1").select("least"), "substring-minimizers")
    found = written(all_segments(slim, window, gram, bloom(twice, "least")).drop("again").join(twice, "least"), "substring-segments")
    different = found.groupBy("least", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "text_key", "start", "n")).alias("one"))
    different = written(different, "substring-different")
    crowded = written(different.groupBy("least").agg(F.count("*").alias("k")).filter(F.col("k") > crowd).select("least", F.lit(True).alias("crowded")), "substring-crowded")
    # kept apart from what follows, so that the join can split the segments of a crowded minimizer
    wanted = written(different.join(crowded, "least", "left").select("least", "content", "copies", F.coalesce("crowded", F.lit(False)).alias("crowded"), "one.*", F.xxhash64("one.id", "one.text_key").alias("row")), "substring-wanted")
    in_index = F.when(F.col("crowded"), F.col("n").cast("long") * window).otherwise(F.col("n") + window - 1) * F.least("copies", F.lit(2))
    words = wanted.agg(F.sum(in_index)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // shard_words))
    by_row = wanted.groupBy("id", "text_key").agg(F.collect_list(F.struct("least", "content", "copies", "crowded", "start", "n")).alias("wanted")).withColumnsRenamed({"id": "id_", "text_key": "key_"})
    lenders = keep_rows(slim.withColumn("row", F.xxhash64("id", "text_key")), "text", passing(bloom(wanted, "row"), "row"))
    texts = lenders.join(by_row, F.col("text_key").eqNullSafe(F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")))
    lent = written(bodies(texts, window), "substring-bodies")
    whole, windows = lent.filter("at IS NULL").select("least", "content", "n", "copies", "body"), lent.filter("at IS NOT NULL")
    # equal windows of crowded minimizers are one row with the sum of their copies
    one = windows.groupBy("window").agg(F.sum("copies").alias("copies"), F.max("body").alias("body"))
    dealt = whole.unionByName(one.select(F.col("window").alias("least"), F.col("window").alias("content"), F.lit(1).alias("n"), "copies", "body"))
    runs = written(shard_repeats(dealt.repartition(parts, "least"), window).withColumnsRenamed({"start": "from", "n": "windows"}), "substring-runs")
    again = runs.filter("least = content").select(F.col("least").alias("window"))
    back = windows.select("least", "content", "at", "window").join(again, "window")
    runs = runs.filter("least <> content").unionByName(back.select("least", "content", F.col("at").alias("from"), F.lit(1).alias("windows")))
    placed = found.join(runs, ["least", "content"]).select("id", "text_key", F.struct((F.col("start") + F.col("from")).alias("start"), F.col("windows").alias("n")).alias("run"))
    return placed.groupBy("id", "text_key").agg(F.collect_set("run").alias("runs"))


def strip(text: bytes, runs: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space."""
    words = text.split()
    if not runs:
        return len(words), 0, b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for r in runs:
        change[r["start"]] += 1
        change[r["start"] + r["n"] + window - 1] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return len(words), int(gone.sum()), b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_key"))


def _hex(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each document: id, words, removed words, and the SHA-256 of what is kept."""
    slim = _slim(docs, id_col, text_col).withColumn(ROW, F.xxhash64("id", "text_key"))
    found = written(repeats(slim.drop(ROW), window, gram, crowd, shard_words).withColumn(ROW, F.xxhash64("id", "text_key")), "substring-losses")
    losers = bloom(found, ROW)

    def first() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def run(batch: pa.RecordBatch) -> dict[str, object]:
            """Texts that lose nothing are through with; only the others go on."""
            text = column(batch, "text").cast(pa.large_binary())
            loses = losers.value.may_hold(column(batch, ROW).to_numpy())
            whole = [None if x else strip(t.as_py() or b"", None, window) for t, x in zip(text, loses.tolist(), strict=True)]
            kept = column(batch, "text").take(pa.array(np.arange(len(loses)), mask=~loses))
            return {TEXT: kept, WORDS: pa.array([w and w[0] for w in whole], pa.int64()), SHA: pa.array([w and _hex(w[2]) for w in whole], pa.string())}

        return run

    def second() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def run(batch: pa.RecordBatch) -> dict[str, object]:
            text, runs = column(batch, TEXT).cast(pa.large_binary()), column(batch, RUNS).to_pylist()
            done = zip(column(batch, WORDS).to_pylist(), column(batch, SHA).to_pylist(), strict=True)
            rows = [(n, 0, sha) if sha else (*(w := strip(t.as_py() or b"", r, window))[:2], _hex(w[2])) for t, r, (n, sha) in zip(text, runs, done, strict=True)]
            return {f.name: pa.array([r[k] for r in rows], pa.string() if k == 2 else pa.int64()) for k, f in enumerate(REPORTED)}

        return run

    begun = T.StructType([T.StructField(TEXT, T.StringType()), T.StructField(WORDS, T.LongType()), T.StructField(SHA, T.StringType())])
    told = add_columns(slim.withColumnRenamed("id", KEPT).withColumnRenamed("text_key", TEXT_KEY), [KEPT, TEXT_KEY, ROW], "text", first, begun)
    joined = told.join(found.drop(ROW).withColumnRenamed("runs", RUNS), F.col(TEXT_KEY).eqNullSafe(F.col("text_key")) & F.col(KEPT).eqNullSafe(F.col("id")), "left")
    made = add_columns(joined.select(KEPT, WORDS, SHA, RUNS, TEXT), [KEPT, WORDS, SHA, RUNS], TEXT, second, REPORTED)
    return made.select(F.col(KEPT).alias(id_col), *REPORTED.names)


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD, shard_words: int = SHARD_WORDS) -> DataFrame:
    """All documents and columns; texts lose their repeated words, the rest joined by one space."""

    def make() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            text = column(batch, TEXT).cast(pa.large_binary())
            return {KEPT: pa.array([strip(t.as_py() or b"", r, window)[2].decode() for t, r in zip(text, column(batch, RUNS).to_pylist(), strict=True)], pa.string())}

        return work

    found = repeats(_slim(docs, id_col, text_col), window, gram, crowd, shard_words)
    same = F.xxhash64(docs[text_col]).eqNullSafe(found["text_key"]) & docs[id_col].eqNullSafe(found["id"])
    told = docs.join(found, same, "left").select(*[docs[f"`{c}`"] for c in docs.columns], docs[text_col].alias(TEXT), found["runs"].alias(RUNS))
    made = add_columns(told, [*docs.columns, RUNS], TEXT, make, T.StructType([T.StructField(KEPT, T.StringType())]))
    return made.select(*[F.col(KEPT).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS k FROM windows SEMI JOIN again USING (h)),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS text FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d) ANTI JOIN gone USING (r, k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""

"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts with one n-gram set form a class. Each class has a MinHash signature of `trees` paths, which an LSH
forest keeps in sorted order (forest.py). Classes are first matched by whole paths. What the exact
similarities of the pairs found so say about the pairs missed (a pair of similarity s meets at depth k
with probability 1 - (1 - s^k)^trees) gives the longest prefix that reaches the target recall; matched
prefixes are shortened to it, but no further than to the depth at which even pairs at the threshold reach
the recall. The links of the forest join classes into groups that hold every candidate pair; in each, all
Jaccard similarities are computed exactly from the n-gram sets. A group of more than `block` classes is
compared block against block in as many tasks as it needs; pairs are counted, never emitted. Shortening
merges groups, and only merged ones are compared again.

Words are runs of letters and digits (any non-ASCII character counts as a letter), lower-cased in A-Z.
A text of fewer words than n is one n-gram. Classes go by a 64-bit hash of the n-gram set.

Rows and values, case by case:
- null text, or text without words: no n-grams, no links; its class is itself.
- null id: joined like any other; a class whose ids are all null has a null id.
- repeated rows and copies: members of one class, each with its own row and links to the others.
- ties: a class is named by its least id. Empty table: no rows. Very long texts: whole.
- further columns: ignored by join(), carried along unchanged by dedupe().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvlake.llm.arrow import add_columns, column, keep_rows, pieces
from solvlake.llm.bloom import bloom, passing
from solvlake.llm.components import connected
from solvlake.llm.forest import DEPTH, LABEL_BITS, plant
from solvlake.llm.shared import cut, written
from solvlake.llm.words import ALNUM, Chunk, chunks, inside, mix, window_hashes

N = 5
THRESHOLD = 0.8
TREES = 32
RECALL = 0.99999
#: Classes compared with each other in one task.
BLOCK = 512
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
#: A column added on the way; no document has such a name.
KEY = "__ngram_join_key"

SIGNED = T.StructType([T.StructField("cls", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("hi", T.ArrayType(T.LongType())), T.StructField("lo", T.ArrayType(T.LongType()))])
VERIFIED = "grp long, cls long, n_links long, n_texts long, root long, met array<double>"


def meet(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """Probability that a pair shares a node of the depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_length(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which pairs at the threshold meet with the recall: prefixes need not be shorter."""
    for k in range(depth, 0, -1):
        if meet(threshold, k, trees) >= recall:
            return k
    raise ValueError("no prefix reaches the recall; more trees are needed")


def ngram_sets(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of the different n-grams of each text, by text."""
    words, first = c.word_hashes, c.first_word
    at = np.flatnonzero(inside(first, len(words), n))
    text, grams = c.text_of_word[at], window_hashes(words, n)[at] if len(at) else np.zeros(0, np.uint64)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = [window_hashes(words[first[i] : first[i] + count[i]], int(count[i]))[0] for i in short]
        text, grams = np.concatenate([text, short]), np.concatenate([grams, mix(np.array(whole, dtype=np.uint64))])
    order = np.lexsort((grams, text))
    text, grams = text[order], grams[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (grams[1:] != grams[:-1])
    return text[new], grams[new]


def sign(text_col: str, n: int, trees: int) -> Callable[[pa.RecordBatch], dict[str, object]]:
    """Class, size of the n-gram set, and paths of each text; the paths once a task for each class."""
    seeds = np.random.default_rng(7).integers(0, 2**63, (2, trees * DEPTH), dtype=np.uint64)
    factors, offsets = seeds[0] * np.uint64(2) + np.uint64(1), seeds[1]
    half, top = DEPTH // 2, np.uint64(64 - LABEL_BITS)
    seen: set[int] = set()

    def paths(grams: np.ndarray, lead: np.ndarray) -> np.ndarray:
        """Texts x trees x 2: the packed labels."""
        out = np.zeros((len(lead), trees, 2), dtype=np.uint64)
        for t in range(trees):
            for k in range(DEPTH):
                least = np.minimum.reduceat((grams ^ offsets[t * DEPTH + k]) * factors[t * DEPTH + k], lead)
                out[:, t, k // half] |= (mix(least) >> top) << (top - np.uint64(LABEL_BITS * (k % half)))
        return out.view(np.int64)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        cls, size, row, found, at = [], [], [], [], 0
        for c in chunks(column(batch, text_col), ALNUM, lower=True):
            texts = c.hi - c.lo
            text, grams = ngram_sets(c, n)
            count = np.bincount(text, minlength=texts)
            own = np.zeros(texts, dtype=np.uint64)
            if len(grams):
                lead = np.flatnonzero(np.diff(text, prepend=-1))
                have = text[lead]
                own[have] = mix(np.add.reduceat(mix(grams), lead) + count[have].astype(np.uint64))
                fresh = [i for i in have.tolist() if not (own[i] in seen or seen.add(own[i]))]
                if fresh:
                    some = np.zeros(texts, dtype=bool)
                    some[fresh] = True
                    part = some[text]
                    found.append(paths(grams[part], np.flatnonzero(np.diff(text[part], prepend=-1))))
                    row.append(np.array(fresh) + at)
            cls.append(own.view(np.int64))
            size.append(count.astype(np.int32))
            at += texts
        places = np.full(at, -1)
        if row:
            places[np.concatenate(row)] = np.arange(sum(map(len, row)))
        flat = np.concatenate(found) if found else np.zeros((0, trees, 2), np.int64)
        index = pa.array(places, mask=places < 0)

        def lists(half: int) -> pa.Array:
            return pa.FixedSizeListArray.from_arrays(pa.array(flat[:, :, half].ravel()), trees).cast(pa.list_(pa.int64())).take(index)

        none = np.zeros(0, np.int64)
        return {"cls": np.concatenate([none, *cls]), "n": np.concatenate([none.astype(np.int32), *size]), "hi": lists(0), "lo": lists(1)}

    return work


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets, left by right (or left by left)."""
    sets = left + (right or [])
    values = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kinds, of, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(kinds), -1)
    place[shared] = np.arange(len(shared))
    col = place[of]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right) if right is not None else len(left)), dtype=np.int64)
    for a in range(0, len(shared), COLUMNS):
        s = slice(np.searchsorted(col, a), np.searchsorted(col, a + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, len(shared) - a)), dtype=np.float32)
        m[row[s], col[s] - a] = 1
        out += (m[: len(left)] @ (m[len(left) :] if right is not None else m).T).astype(np.int64)
    return out


def similar(common: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    return common >= threshold * (left[:, None] + right[None, :] - common) - 1e-9


def roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each row's component in a symmetric matrix."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(label)).min(axis=1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verify(threshold: float, trees: int, floor: int) -> Callable[[pa.Table], pa.Table]:
    """Links of one pair of blocks: a row for each class, with the least class that it is linked to here, and
    how many pairs like its linked ones there are (each stands for as many as it had chances not to meet)
    and meet at each depth from floor on."""

    def run(t: pa.Table) -> pa.Table:
        cls, one = np.unique(t["cls"].to_numpy(), return_index=True)
        side, size = t["part"].to_numpy()[one], t["size"].to_numpy()[one]
        sets = [np.frombuffer(t["grams"][int(i)].as_py(), dtype=np.uint64) for i in one]
        low, high = t["low"][0].as_py(), t["high"][0].as_py()
        n = np.array([len(s) for s in sets])
        linked = np.zeros((len(cls), len(cls)), dtype=bool)
        a, b = (np.arange(len(cls)),) * 2 if low == high else (np.flatnonzero(side == low), np.flatnonzero(side == high))
        i, j, likeness = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(a) and len(b):
            common = overlaps([sets[k] for k in a], None if low == high else [sets[k] for k in b])
            found = similar(common, n[a], n[b], threshold)
            if low == high:
                np.fill_diagonal(found, False)
            i, j = np.nonzero(found)
            likeness = common[i, j] / (n[a[i]] + n[b[j]] - common[i, j])
            i, j = a[i], b[j]
            if low != high:
                i, j, likeness = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([likeness, likeness])
            linked[i, j] = True
        weight = 1 / meet(likeness, DEPTH, trees)
        met = np.stack([np.bincount(i, weights=w, minlength=len(cls)) for w in (weight, *(weight * meet(likeness, k, trees) for k in range(floor, DEPTH + 1)))], axis=1)
        return pa.table(
            {
                "grp": pa.array([t["root"][0].as_py()] * len(cls), pa.int64()),
                "cls": cls,
                "n_links": np.bincount(i, weights=size[j], minlength=len(cls)).astype(np.int64),
                "n_texts": np.bincount(i, minlength=len(cls)).astype(np.int64),
                "root": cls[roots(linked)],
                "met": pa.FixedSizeListArray.from_arrays(pa.array(met.ravel()), met.shape[1]).cast(pa.list_(pa.float64())),
            }
        )

    return run


def gram_rows(df: DataFrame, text_col: str, n: int) -> DataFrame:
    """cls, root, parts, size and the n-gram set of each row; copies within a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces(whole, text_col):
                sets: dict[int, bytes] = {}
                for c in chunks(column(batch, text_col), ALNUM, lower=True):
                    text, grams = ngram_sets(c, n)
                    border = np.searchsorted(text, np.arange(c.hi - c.lo + 1))
                    sets |= {c.lo + i: grams[border[i] : border[i + 1]].tobytes() for i in range(c.hi - c.lo)}
                fresh = []
                for i, k in enumerate(column(batch, "cls").to_pylist()):
                    if k not in seen:
                        seen.add(k)
                        fresh.append(i)
                at = pa.array(fresh, pa.int64())
                yield pa.RecordBatch.from_arrays([column(batch, x).take(at) for x in ("cls", "root", "parts", "size")] + [pa.array([sets[i] for i in fresh], pa.binary())], names=["cls", "root", "parts", "size", "grams"])

    return df.select("cls", "root", "parts", "size", text_col).mapInArrow(run, "cls long, root long, parts long, size long, grams binary")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


class Join:
    """The join of one DataFrame; its steps are kept in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, trees: int, recall: float, block: int):
        self.n, self.threshold, self.trees, self.recall, self.block = n, threshold, trees, recall, block
        self.floor = prefix_length(threshold, trees, DEPTH, recall)
        self.slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), text_key(docs[text_col]).alias("text_key"))
        signed = cut(add_columns(self.slim, ["id", "text_key"], "text", lambda: sign("text", n, trees), SIGNED))
        self.rows = signed.drop("hi", "lo")
        path = F.first(F.when(F.col("hi").isNotNull(), F.struct("hi", "lo")), ignorenulls=True)
        classes = signed.filter("n > 0").groupBy("cls").agg(F.min(F.struct("id", "text_key")).alias("one"), F.min("id").alias("copy_id"), F.count("*").alias("size"), path.alias("path"))
        classes = written(classes, "ngram-classes")
        self.classes = classes.drop("path")
        paths = classes.select("cls", F.posexplode(F.arrays_zip("path.hi", "path.lo")).alias("tree", "p")).select("tree", "p.hi", "p.lo", "cls")
        self.verified = self._joined(plant(paths, self.floor))
        self.roots = connected(self.verified.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")

    def _joined(self, links: DataFrame) -> DataFrame:
        """The verified groups at the depth that the recall asks for."""
        deep = written(connected(links.filter(F.col("depth") == DEPTH).select("a", "b")), "ngram-groups")
        first = cut(self._verified(deep))
        self.depth = self._depth(first)
        if self.depth == DEPTH:
            return first
        # the shorter prefixes' links, between groups in place of classes
        more = links.filter((F.col("depth") >= self.depth) & (F.col("depth") < DEPTH)).select("a", "b")
        for end in ("a", "b"):
            more = more.join(deep.select(F.col("node").alias(end), F.col("root").alias(f"{end}_")), end, "left").withColumn(end, F.coalesce(f"{end}_", end)).drop(f"{end}_")
        merged = written(connected(more), "ngram-merged")
        top = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
        groups = deep.join(top, "root").select("node", F.col("top").alias("root")).unionByName(merged.join(deep.select("node"), "node", "left_anti"))
        again = self._verified(groups)
        return cut(first.join(merged.select(F.col("node").alias("grp")), "grp", "left_anti").unionByName(again))

    def _depth(self, first: DataFrame) -> int:
        """The longest prefix with the recall, by the pairs that whole paths have found; the shortest if they found none."""
        sums = {r.pos: r.s for r in first.select(F.posexplode("met")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}  # a row a depth
        if not sums.get(0):
            return self.floor
        return max((k for k in range(self.floor, DEPTH + 1) if sums[1 + k - self.floor] >= self.recall * sums[0]), default=self.floor)

    def _verified(self, groups: DataFrame) -> DataFrame:
        sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / self.block).cast("long").alias("parts"))
        wanted = groups.join(sizes, "root").join(self.classes, groups["node"] == self.classes["cls"]).select("cls", "root", "parts", "size", F.col("one.id").alias("one_id"), F.col("one.text_key").alias("one_key"))
        wanted = written(wanted.withColumn("row", F.xxhash64("one_id", "one_key")), "ngram-wanted")
        # texts of the groups only: a Bloom filter, and then the exact join
        some = keep_rows(self.slim.withColumn("row", F.xxhash64("id", "text_key")), "text", passing(bloom(wanted, "row"), "row"))
        texts = some.drop("row").join(wanted.drop("row"), F.col("text_key").eqNullSafe(F.col("one_key")) & F.col("id").eqNullSafe(F.col("one_id")))
        grams = gram_rows(texts, "text", self.n).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
        pairs = grams.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        dealt = pairs.select("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "cls", "size", "grams")
        return dealt.groupBy("root", "low", "high").applyInArrow(verify(self.threshold, self.trees, self.floor), VERIFIED)

    def result(self) -> DataFrame:
        """id, text_key, class_id, copy_id, n_links, n_texts and the winner of its class of every row."""
        links = self.verified.groupBy("cls").agg(F.sum("n_links").alias("n_links"), F.sum("n_texts").alias("n_texts"))
        told = self.classes.join(links, "cls", "left").join(self.roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        named = told.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min("one").alias("winner"))
        told = told.join(named, "root").select("cls", "class_id", "copy_id", "winner", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"))
        some = self.rows.filter("n > 0").join(told, "cls").select("id", "text_key", "class_id", "copy_id", "n_links", "n_texts", "winner")
        alone = self.rows.filter("n = 0").select("id", "text_key", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"), F.struct("id", "text_key").alias("winner"))
        return some.unionByName(alone)


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """A row for each document: id; class_id, the least id that it is linked to directly or through
    others; copy_id, the least id with its n-gram set; n_links, the other documents whose similarity
    reaches the threshold; n_texts, how many different n-gram sets those have besides its own."""
    found = Join(docs, id_col, text_col, n, threshold, trees, recall, block).result()
    return found.select(F.col("id").alias(id_col), "class_id", "copy_id", "n_links", "n_texts")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One document of each class, the one with the least id (then text hash), with all its columns;
    documents without words all stay."""
    found = Join(docs, id_col, text_col, n, threshold, trees, recall, block).result()
    own = F.struct("id", "text_key")
    told = cut(found.groupBy("id", "text_key").agg(F.min("winner").alias("winner"), F.count("*").alias("rows"), F.max("n_links").alias("links")))
    lost = told.filter(~own.eqNullSafe(F.col("winner"))).select("id", "text_key")
    again = told.filter(own.eqNullSafe(F.col("winner")) & (F.col("rows") > 1) & (F.col("links") > 0)).select("id", "text_key")
    same = lambda other: docs[id_col].eqNullSafe(other["id"]) & text_key(docs[text_col]).eqNullSafe(other["text_key"])
    if again.isEmpty():
        return docs.join(lost, same(lost), "left_anti")
    # rows that are there twice and more: one of them
    gone = lost.unionByName(again)
    one = docs.join(again, same(again), "left_semi").withColumn(KEY, text_key(docs[text_col])).dropDuplicates([id_col, KEY]).drop(KEY)
    return docs.join(gone, same(gone), "left_anti").unionByName(one)


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, least(len(w), {N}) AS k, unnest(range(1, len(w) - least(len(w), {N}) + 2)) AS i FROM d WHERE len(w) > 0)),
sets AS (SELECT r, count(*) AS n, md5(string_agg(g, ',' ORDER BY g)) AS kind FROM grams GROUP BY r),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE c >= {THRESHOLD} * (a.n + b.n - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
groups AS (SELECT x AS r, min(doc_id) AS least FROM reach JOIN d ON d.r = y GROUP BY x),
copies AS (SELECT kind, min(doc_id) AS copy_id FROM sets JOIN d USING (r) GROUP BY kind),
counts AS (SELECT x AS r, count(*) AS n_links, count(DISTINCT b.kind) FILTER (b.kind <> a.kind) AS n_texts FROM links JOIN sets a ON a.r = x JOIN sets b ON b.r = y GROUP BY x)
SELECT doc_id, coalesce(least(least, doc_id), doc_id) AS class_id, coalesce(copy_id, doc_id) AS copy_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_texts, 0)::BIGINT AS n_texts
FROM d LEFT JOIN sets USING (r) LEFT JOIN copies USING (kind) LEFT JOIN groups USING (r) LEFT JOIN counts USING (r)
"""

"""Token counts as delta-maintained rollups.

A change is an insert, a delete, or a revision of a document (its old and its new image). Changes are
counted with a tokenizer and become signed deltas by source, language and tokenizer version; totals
are the sums of all committed deltas, so nothing is ever counted twice or updated in place. A batch is
committed under its id: its delta is written to a folder of its own and becomes visible with a marker
that names it. The marker is renamed into place whole, and only if there is none, so a batch that is run
again counts once: after it was committed it changes nothing, and after a crash at any point before that
it is committed then. A compacted rollup remembers the batches that its snapshot covers.

Rows and values, case by case:
- null or empty text: 0 tokens; the document counts. Null source or language: a group of its own.
- repeated rows: each counts, as they are separate changes. Ties: none, sums only.
- an unknown sign or a null sign: rejected by the reader of changes (ValueError when counted).
- empty batches: committed without rows. Very long texts: counted whole.
- further columns: ignored.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvlake.llm.arrow import column, pieces, small_batches
from solvlake.sources.files import publish_text

#: Fixed value: how byte-level BPE vocabularies split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Distinct sources or languages are few; a task sums its groups in memory up to this many.
GROUPS_HELD = 1 << 16

DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def version_of(path: str) -> str:
    return re.sub(r"\.[a-z]+$", "", path.rsplit("/", 1)[-1])


def encoder(ranks: dict[bytes, int], name: str) -> Callable[[str], list[int]]:
    """Token ids of a text under a byte-level BPE vocabulary."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def counter(ranks: dict[bytes, int], name: str) -> Callable[[str], int]:
    """Number of tokens of a text under a byte-level BPE vocabulary."""
    encode = encoder(ranks, name)
    return lambda text: len(encode(text))


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def inserts(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Changes (sign, text, source, lang) that insert every document."""
    return docs.select(F.lit(1).alias("sign"), docs[text_col].alias("text"), docs[source_col].alias("source"), docs[lang_col].alias("lang"))


def deletes(docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Changes that take every document away again."""
    return inserts(docs, text_col, source_col, lang_col).withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame, **columns: str) -> DataFrame:
    """Changes from old images to new ones."""
    return deletes(old, **columns).unionByName(inserts(new, **columns))


def delta(changes: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Signed totals of a batch of changes; the vocabulary goes to the executors from the driver."""
    small_batches(changes)
    version = version_of(tokenizer)
    ranks = changes.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))  # a vocabulary file, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value, version)
        held: dict[tuple[str | None, str | None], list[int]] = {}

        def rows() -> pa.RecordBatch:
            kinds = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in kinds], pa.string()), pa.array([x for _, x in kinds], pa.string()), pa.array([version] * len(kinds), pa.string()), pa.array([held[k][0] for k in kinds], pa.int64()), pa.array([held[k][1] for k in kinds], pa.int64())],
                names=["source", "lang", "tokenizer_version", "n_docs", "n_tokens"],
            )

        for whole in batches:
            for batch in pieces(whole, "text"):
                signs = column(batch, "sign").to_pylist()
                if not set(signs) <= {1, -1}:
                    raise ValueError("a change has sign 1 or -1")
                for sign, text, source, lang in zip(signs, column(batch, "text"), column(batch, "source").to_pylist(), column(batch, "lang").to_pylist(), strict=True):
                    group = held.setdefault((source, lang), [0, 0])
                    group[0] += sign
                    group[1] += sign * count(text.as_py() or "")
                if len(held) > GROUPS_HELD:
                    yield rows()
                    held.clear()
        yield rows()

    keys = ["source", "lang", "tokenizer_version"]
    return changes.select("sign", "text", "source", "lang").mapInArrow(run, DELTA).groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in a folder: deltas/<attempt>/ holds written deltas, commits/<batch>.json the marker of each
    batch: the name of its delta, and for a snapshot the batches that it covers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _marker(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch id has letters, digits, _ . - only")
        return f"{self.path}/commits/{batch}.json"

    def _markers(self) -> list[dict]:
        """A line for each committed batch or snapshot; markers that a dead writer left empty have none."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at) or not fs.listStatus(at):
            return []
        return [json.loads(r.value) for r in self.spark.read.text(f"{self.path}/commits").collect() if r.value]

    def batches(self) -> set[str]:
        """Ids of all batches that count."""
        return {b for m in self._markers() for b in m["batches"]}

    def committed(self, batch: str) -> bool:
        self._marker(batch)
        return batch in self.batches()

    def commit(self, batch: str, changes: DataFrame, tokenizer: str = TOKENIZER) -> bool:
        """Adds a batch of changes; False, and nothing done, if the batch is there already."""
        if self.committed(batch):
            return False
        attempt = f"{batch}-{np.random.default_rng().integers(2**62):x}"
        delta(changes, tokenizer).write.parquet(f"{self.path}/deltas/{attempt}")
        return publish_text(self.spark, self._marker(batch), json.dumps({"delta": attempt, "batches": [batch]}))

    def deltas(self) -> DataFrame:
        """All committed deltas."""
        names = [m["delta"] for m in self._markers()]
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.path}/deltas/{n}" for n in names])

    def totals(self) -> DataFrame:
        """Current totals by source, language and tokenizer version; groups without documents are gone."""
        keys = ["source", "lang", "tokenizer_version"]
        return self.deltas().groupBy(*keys).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, name: str) -> None:
        """Replaces nothing in place: commits a snapshot in a new folder, as one delta of the same totals
        that covers the same batches."""
        target, markers = Rollup(self.spark, name), self._markers()
        seen = Rollup(self.spark, self.path)
        seen._markers = lambda: markers
        attempt = f"snapshot-{np.random.default_rng().integers(2**62):x}"
        seen.totals().write.parquet(f"{target.path}/deltas/{attempt}")
        if not publish_text(self.spark, target._marker("snapshot"), json.dumps({"delta": attempt, "batches": sorted({b for m in markers for b in m["batches"]})})):
            raise FileExistsError(f"{name} has a snapshot already")

"""Quality rules by compression bands.

Every text is compressed with zstandard, whole and in fixed chunks. Repetitive text compresses too
well, encoded or random text hardly at all; what is usual depends on the length, so each length has
its own lowest and highest ratio of raw to compressed size.

Rows and values, case by case:
- null text: treated as empty. Empty text: no words, all counts 0, base_failed, not kept.
- very long text: compressed chunk by chunk as well; nothing is cut off.
- repeated rows: each is judged for itself and gives its own row. Empty table: no rows.
- further columns: ignored by measure(), carried along unchanged by keep().
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from solvlake.llm.arrow import add_columns, column, keep_rows
from solvlake.llm.words import NOT_SPACE, Chunk, byte_class, chunks, inside, mix, segments, window_hashes

#: (bytes from, lowest ratio, highest ratio): the band of the texts that are at least so long.
BANDS: tuple[tuple[int, float, float], ...] = (
    (0, 0.0, 9.0),
    (128, 0.95, 2.15),
    (256, 1.10, 2.15),
    (512, 1.25, 2.20),
    (1024, 1.35, 2.30),
    (2048, 1.40, 2.40),
    (4096, 1.45, 2.50),
    (8192, 1.45, 2.57),
    (16384, 1.45, 2.65),
    (32768, 1.45, 2.75),
    (65536, 1.45, 3.00),
)
CHUNK = 4096
LEVEL = 3
#: A text goes if chunks outside their band hold more than this share of its bytes.
MOST_BAD = 0.5

_NEWLINE = byte_class(b"\n")
_SYMBOL = byte_class(b"#*$%&|<>")

MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField("ratio", T.DoubleType()), T.StructField("bad_share", T.DoubleType())]
)


def outside(raw: int, packed: int, bands: tuple[tuple[int, float, float], ...]) -> bool:
    """Whether a text of raw bytes that packs into so many lies outside the band of its length."""
    band = next(b for b in reversed(bands) if raw >= b[0])
    ratio = raw / max(packed, 1)
    return not band[1] <= ratio <= band[2]


def compression(text: bytes, packer: zstandard.ZstdCompressor, bands: tuple[tuple[int, float, float], ...], chunk: int) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in bad chunks, and whether the method keeps it."""
    if not text:
        return 0.0, 0.0, False
    packed = len(packer.compress(text))
    bad = outside(len(text), packed, bands)
    if len(text) <= chunk:
        return len(text) / packed, float(bad), not bad
    lost = 0
    for at in range(0, len(text), chunk):
        part = text[at : at + chunk]
        if outside(len(part), len(packer.compress(part)), bands):
            lost += len(part)
    return len(text) / packed, lost / len(text), not bad and lost <= MOST_BAD * len(text)


def counts(c: Chunk) -> dict[str, np.ndarray]:
    """The base counts of each text of the chunk."""
    first = c.first_word
    points = (c.data & 0xC0) != 0x80
    out = {"n_words": np.diff(first), "word_chars": c.sums_by_text(points & c.mask), "n_symbols": c.sums_by_text(_SYMBOL[c.data])}

    starts, ends = segments(~_NEWLINE[c.data], c.offsets)
    filled = np.zeros(len(c.data) + 1, dtype=np.int64)
    np.cumsum(c.mask, out=filled[1:])
    worded = filled[ends] > filled[starts]
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(c.offsets, starts, "right") - 1
    lines = np.bincount(text, minlength=c.hi - c.lo)
    _, one = np.unique(mix(c.hashes(starts, ends) + text.astype(np.uint64)), return_index=True)
    out["n_dup_lines"] = lines - np.bincount(text[one], minlength=c.hi - c.lo)

    words = c.word_hashes
    at = np.flatnonzero(inside(first, len(words), 3))
    key = mix(window_hashes(words, 3)[at] + c.text_of_word[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[at[again] + k] = True
    total = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(covered, out=total[1:])
    out["n_repeat_words"] = total[first[1:]] - total[first[:-1]]
    return out


def judge(text: str, bands: tuple[tuple[int, float, float], ...], chunk: int, level: int) -> Callable[[pa.RecordBatch], dict[str, object]]:
    packer = zstandard.ZstdCompressor(level=level)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        parts: dict[str, list[np.ndarray]] = {f.name: [] for f in MEASURES.fields}
        for c in chunks(column(batch, text), NOT_SPACE):
            found = counts(c)
            n, r = found["n_words"], found["n_repeat_words"]
            found["base_failed"] = (n < 50) | (100 * r > 50 * n)
            view = memoryview(c.data)
            packed = [compression(bytes(view[a:b]), packer, bands, chunk) for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)]
            found["ratio"] = np.array([x[0] for x in packed])
            found["bad_share"] = np.array([x[1] for x in packed])
            found["kept"] = ~found["base_failed"] & np.array([x[2] for x in packed], dtype=bool)
            for k, v in found.items():
                parts[k].append(v)
        return {k: np.concatenate(v) if v else np.zeros(0) for k, v in parts.items()}

    return work


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple[tuple[int, float, float], ...] = BANDS, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """A row for each document: its id, the base counts, the ratios and the verdict."""
    return add_columns(docs, [id_col], text_col, lambda: judge(text_col, bands, chunk, level), MEASURES)


def keep(docs: DataFrame, text_col: str = "text", bands: tuple[tuple[int, float, float], ...] = BANDS, chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """The documents that the rules keep, with all their columns."""

    def make() -> Callable[[pa.RecordBatch], np.ndarray]:
        work = judge(text_col, bands, chunk, level)
        return lambda batch: np.asarray(work(batch)["kept"], dtype=bool)

    return keep_rows(docs, text_col, make)

import base64
import random
import re
from collections import Counter

import zstandard

from solvlake.llm import quality
from tests.llm.corpus import documents, rows, with_extra


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def verdict(text, failed):
    raw, z = (text or "").encode(), zstandard.ZstdCompressor(level=quality.LEVEL)
    if failed or not raw:
        return False
    out = lambda part: quality.outside(len(part), len(z.compress(part)), quality.BANDS)
    parts = [raw[i : i + quality.CHUNK] for i in range(0, len(raw), quality.CHUNK)]
    return not out(raw) and (len(parts) == 1 or sum(len(p) for p in parts if out(p)) <= quality.MOST_BAD * len(raw))


def test_against_brute_force(spark):
    made = rows() + [(900, "a | b # c\nx\nx\n\nx \n", "en", "s", 1), (901, "#*$%&|<>" * 40, "en", "s", 1)]
    found = quality.measure(documents(spark, made)).collect()
    assert len(found) == len(made)
    want = sorted(((i is None, i or 0), *brute(t), verdict(t, brute(t)[-1])) for i, t, *_ in made)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found)
    assert got == want


def test_repetitive_and_random_text_goes(spark):
    rng = random.Random(3)
    plain = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400))
    block = " ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(60))
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(400))
    df = documents(spark, [(1, plain, "en", "s", 1), (2, " ".join(f"{block} {i}" for i in range(40)), "en", "s", 1), (3, noise, "en", "s", 1)])
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.measure(df).collect()}
    assert got[1] == (False, True) and not got[2][1] and got[3] == (False, False)


def test_keep_carries_all_columns_and_empty_tables_work(spark):
    df = with_extra(spark, rows())
    kept = quality.keep(df)
    assert kept.schema == df.schema
    assert kept.count() == quality.measure(df).filter("kept").count()
    assert quality.measure(df.limit(0)).count() == 0 and quality.keep(df.limit(0)).count() == 0

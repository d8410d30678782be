import hashlib
import re
from collections import defaultdict

import pytest

from solvlake.llm import decontam
from tests.llm.corpus import documents, rows, with_extra

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(made, items):
    windows = defaultdict(set)
    for i, text in items:
        w = split(text)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add("null" if i is None else str(i))
    sizes = {len(k) for k in windows}
    for i, text, *_ in made:
        w, hit, found = split(text), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if own := windows.get(tuple(w[a : a + k])):
                    hit.update(range(a, a + k))
                    found |= own
        yield (i is None, i or 0), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def items_of(made):
    texts = [r[1] for r in made]
    return [(1, " ".join(texts[0].split()[5:30])), (2, texts[1].upper()), (3, "w1, changed"), (10, " ".join(texts[31].split()[28:70])), (10, "again under one id of nothing else at all here now yes"), (None, " ".join(texts[2].split()[:12])), (5, None), (6, ""), (7, "..."), (8, " ".join(texts[0].split()[5:30])), (9, "Of " * 30)]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_against_brute_force(spark, block_bytes):
    made = rows()
    items = items_of(made)
    found = decontam.match(documents(spark, made), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    assert got == sorted(brute(made, items))


def test_longest_match_and_place(spark):
    made = [(1, "x y " + " ".join(f"k{i}" for i in range(40)) + " z", "en", "s", 1)]
    items = spark.createDataFrame([(4, "q " + " ".join(f"k{i}" for i in range(3, 30)))], "item_id long, text string")
    r = decontam.match(documents(spark, made), items).first()
    assert (r.longest, r.longest_at, r.longest_item, r.n_hit) == (27, 5, "4", 27)


def test_remove_keeps_clean_documents_whole(spark):
    made = rows()
    df, items = with_extra(spark, made), spark.createDataFrame(items_of(made), "item_id long, text string")
    bad = decontam.match(df, items).filter("contaminated").count()
    kept = decontam.remove(df, items)
    assert kept.schema == df.schema and 0 < bad < len(made) and kept.count() == len(made) - bad
    assert decontam.remove(df, items.limit(0)).count() == len(made)
    assert decontam.match(df.limit(0), items).count() == 0


def brute_longest(text, items):
    """Length, place and item of the longest match: the first place, the least item."""
    w, best = split(text), []
    for name, item in items:
        v = split(item)
        after = [0] * (len(v) + 1)
        for a in range(len(w) - 1, -1, -1):
            after = [after[k + 1] + 1 if w[a] == v[k] else 0 for k in range(len(v))] + [0]
            best.append((-max(after), a, str(name)))
    length, place, name = min(best)
    return -length, place, name


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_matches_longer_than_a_row(spark, block_bytes):
    k = [f"k{i}" for i in range(700)]
    # 3 and 4 begin alike and go on differently; 5 repeats one word; 6 is in 3
    items = [(3, " ".join(k[:400])), (4, " ".join(k[:150] + k[500:700])), (5, "so " * 300), (6, " ".join(k[20:320])), (7, " ".join(k[600:]))]
    texts = [
        " ".join(["x"] + k[:140] + ["y"] + k[:390] + ["z"]),
        " ".join(["x"] + k[:150] + k[500:690]),
        " ".join(k[130:300] + ["y"] + k[30:310]),
        "so " * 250 + "x " + "so " * 290 + "y",
        "so " * 400,
        " ".join(k[:128]) + " x",
        " ".join(k[:129] + ["x"] + k[560:]),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n long")
    got = decontam.match(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(r.longest, r.longest_at, r.longest_item) for r in got] == [brute_longest(t, items) for t in texts]
    assert got[0].longest == 390 and got[0].longest_at == 142

import re
from itertools import permutations

from solvlake.llm import audit
from tests.llm.corpus import documents, rows, with_extra


def brute(made, told):
    good, toxic = ({i for i, q, t in told if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, *_ in made:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, _, source, _ in made:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and least[text] < i}
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                before = set(order[: step - 1])
                out[part, order, step] = [len(kept), len(gone), sum(f in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = kept
        for f in "ABCDE":
            total = sum(out[part, o, o.index(f) + 1][1] for o in map("".join, permutations("ABCDE")))
            for o in map("".join, permutations("ABCDE")):
                out[part, o, o.index(f) + 1].append(total)
    return sorted((*k, *v) for k, v in out.items())


def made():
    texts = ["AB " * 300, "Of $ " * 250, "one of a kind # " + " ".join(f"w{k}" for k in range(300)), " ".join(f"w{k}" for k in range(300)), "Mixed CASE case"]
    out = rows() + [(100 + 10 * k + c, t, "en", s, 1) for k, t in enumerate(texts) for c, s in enumerate(["src0", "src1", None, ""])]
    return out + [(7, "same id, other text", "en", "src0", 1), (None, texts[3], "en", "src1", 1)]


def labels():
    return [(i, i % 2, (i // 2) % 2) for i in range(0, 60)] + [(100, 1, 0), (100, 0, 1), (110, None, 1), (None, 1, 1), (9999, 1, 1)]


def test_against_brute_force(spark):
    told = spark.createDataFrame(labels(), "doc_id long, quality int, toxic int")
    want = brute(made(), labels())
    for df in (documents(spark, made()), with_extra(spark, made())):
        got = audit.audit(df, told)
        assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, got.collect())) == want


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = documents(spark, made())
    assert sorted(map(tuple, audit.audit(df, none).collect())) == brute(made(), [])
    assert audit.audit(df.limit(0), none).count() == 0


def test_shapley_counts_sum_to_what_any_order_removes(spark):
    told = spark.createDataFrame(labels(), "doc_id long, quality int, toxic int")
    got = audit.audit(documents(spark, made()), told).collect()
    for part in {r.part for r in got}:
        first = [r for r in got if r.part == part and r.filter_order == "ABCDE"]
        assert sum(r.shapley for r in first) == 120 * sum(r.removed for r in first)


def test_no_text_is_shuffled(spark):
    told = spark.createDataFrame(labels(), "doc_id long, quality int, toxic int")
    plan = audit.audit(documents(spark, made()), told)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)

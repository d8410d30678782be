import hashlib
import re

from solvlake.llm import infill
from tests.llm.corpus import documents, rows, with_extra

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(made):
    out = []
    for i, text, *_ in made:
        text = text or ""
        h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        units = UNIT.findall(text)
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        made_of = {"plain": text, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        sizes = (None, None) if form == "plain" else (len(pre), len(mid))
        out.append((i, n, form, *sizes, *(hashlib.sha256(x.encode()).hexdigest() for x in (made_of, text))))
    return sorted(out, key=str)


def made():
    odd = [" lead and trail \n", "\n\n\n", "<P> inside", "ends with <", "<S", "M> <M", "😀 é x \x0b\x0c tab\there", "a" * 100_000, "x " * 100_000, " " * 50_000 + "z", "P><P", "<" * 50]
    # several ids for each, as the id decides the form
    return rows() + [(1000 + 20 * k + i, t, "en", "src0", len(t)) for k, t in enumerate(odd) for i in range(8)]


def test_against_brute_force(spark):
    got = infill.digests(infill.rearrange(documents(spark, made())))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(made())


def test_round_trip_at_every_rate(spark):
    df = documents(spark, made())
    for first in (0, 100):
        got = infill.rearrange(df, rate=100, suffix_first=first)
        told = got.withColumn("again", infill.restored(got["form"], got["output"])).select("doc_id", "form", "again").collect()
        assert {r.form for r in told} == {"plain", "spm" if first else "psm"}
        assert sorted(((r.doc_id, r.again) for r in told), key=str) == sorted(((r[0], r[1] or "") for r in made()), key=str)


def test_extra_columns_and_empty_tables(spark):
    df = with_extra(spark, made())
    assert sorted(map(tuple, infill.digests(infill.rearrange(df)).collect()), key=str) == brute(made())
    assert infill.rearrange(df.limit(0)).count() == 0


def test_units_are_never_shuffled(spark):
    plan = infill.rearrange(documents(spark, made()))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning", line)]
    assert exchanges and all("REPARTITION_BY_COL" in line for line in exchanges)

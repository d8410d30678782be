"""Small corpora with copies, near copies, shared passages and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", id string, text_key long, cls string, runs string, n_words string, `a.b` int"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" + rng.choice(["", "", ",", "é", "."]) for _ in range(n)]


def rows(seed: int = 1) -> list[tuple]:
    """Documents: plain ones, exact and near copies, a passage that many share, and the odd ones."""
    rng = random.Random(seed)
    texts: list[str | None] = [" ".join(words(rng, rng.randrange(40, 160))) for _ in range(30)]
    passage = words(rng, 50)
    for k in range(8):
        texts.append(" ".join(words(rng, 30) + passage + words(rng, 5 * k)))
    for k in range(6):
        near = (texts[k] or "").split(" ")
        near[len(near) // 2] = "changed"
        texts += [texts[k], " ".join(near)]
    texts += [None, "", "   \n\t ", "one", "two words", "Of " * 120, "Of " * 34, "Of " * 36, "x\n" * 50, "a b c " * 3000, " ".join(words(rng, 20000, 5000))]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]), len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, out[5][1], "en", "src1", 1), (None, None, None, None, None), (None, "alone here", None, None, None)]
    return out


def documents(spark, made: list[tuple]):
    return spark.createDataFrame(made, SCHEMA)


def with_extra(spark, made: list[tuple]):
    """The same documents with further columns, some named like columns inside the operators."""
    return spark.createDataFrame([(*r, "x", 7, None, "y", "z", 5) for r in made], EXTRA)

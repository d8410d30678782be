import re

import numpy as np
import pyarrow as pa

from solvlake.llm.words import ALNUM, NOT_SPACE, chunks, inside, run_hashes, whole_hashes, window_hashes

TEXTS = ["ab cd ab", "", None, "cd", "  x", "éa ab\nq", "A-B c", "\x0b\x1cz\x85"]


def test_words_and_hashes_agree_with_a_pattern():
    for limit in (1, 8, 1 << 20):
        seen = {}
        for c in chunks(pa.array(TEXTS), NOT_SPACE, limit=limit):
            for i in range(c.lo, c.hi):
                own = re.findall(r"[^\x20\x09-\x0D]+", TEXTS[i] or "")
                a, b = c.first_word[i - c.lo : i - c.lo + 2]
                assert b - a == len(own)
                for w, h in zip(own, c.word_hashes[a:b]):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_lower_case_letters_and_digits():
    c = next(chunks(pa.array(["Ab1-É ab1"]), ALNUM, lower=True))
    assert len(c.word_hashes) == 3 and c.word_hashes[0] == c.word_hashes[2]


def test_windows():
    c = next(chunks(pa.array(["a b c a b", "a b"]), NOT_SPACE))
    h = window_hashes(c.word_hashes, 2)
    assert h[0] == h[3] == h[5] and len(set(h.tolist())) == 4
    assert inside(c.first_word, 7, 2).tolist() == [True, True, True, True, False, True]
    assert len(window_hashes(np.zeros(1, np.uint64), 3)) == 0


def thue_morse(n, a, b):
    return [(a, b)[bin(i).count("1") & 1] for i in range(n)]


def test_regular_structure_does_not_cancel_out():
    """Sums of powers modulo a power of two are equal for a Thue-Morse sequence and its complement."""
    for n in (2**k for k in range(4, 15)):
        words = ["".join(thue_morse(n, *p)) for p in ("ab", "ba")]
        lines = [" ".join(thue_morse(n, *p)) for p in ("ab", "ba")]
        by_word = [next(chunks(pa.array([t]), NOT_SPACE)) for t in (*words, *lines)]
        assert by_word[0].word_hashes[0] != by_word[1].word_hashes[0]
        assert whole_hashes(by_word[2])[0] != whole_hashes(by_word[3])[0]
        assert window_hashes(by_word[2].word_hashes, n)[0] != window_hashes(by_word[3].word_hashes, n)[0]


def test_ranges_of_every_length():
    rng = np.random.default_rng(1)
    base = rng.integers(97, 99, 60, dtype=np.uint8)
    c = next(chunks(pa.array([base.tobytes().decode() + "  " + base.tobytes().decode()]), NOT_SPACE))
    starts, ends = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(61)))
    starts, ends = starts[starts <= ends], ends[starts <= ends]
    h, again = c.hashes(starts, ends), c.hashes(starts + 62, ends + 62)
    assert (h == again).all()
    seen = {}
    for a, b, x in zip(starts, ends, h):
        assert seen.setdefault(base[a:b].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
    zeros = next(chunks(pa.array(["\0" * 40]), NOT_SPACE))
    assert len(set(zeros.hashes(np.zeros(40, np.int64), np.arange(1, 41)).tolist())) == 40


def test_runs_of_words():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 200).astype(np.uint64)
    starts, lengths = rng.integers(0, 150, 3000), rng.integers(0, 50, 3000)
    seen = {}
    for a, n, x in zip(starts, lengths, run_hashes(words, starts, lengths)):
        assert seen.setdefault(words[a : a + n].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
    assert len(run_hashes(words, starts[:0], lengths[:0])) == 0

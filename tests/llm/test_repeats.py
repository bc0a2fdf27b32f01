import hashlib
import random

import numpy as np
import pytest

from calibra.llm import repeats
from calibra.llm.common import table
from calibra.llm.repeats import WINDOW, cut_repeats, op11_grouped_suffixes
from calibra.llm.suffixes import equal_windows, string_order, suffix_order

SCHEMA = "doc_id long, text string, lang string, at string, digest int"


def brute(rows):
    """By a set of all strings of WINDOW bytes, in order; repeated rows one after another."""
    order = lambda r: (r[0] is not None, r[0] or 0)
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=order):
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - WINDOW + 1):
            w = b[i : i + WINDOW]
            if w in seen:
                gone[i] += 1
                gone[min(i + WINDOW, len(b))] -= 1
            seen.add(w)
        covered = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((doc_id, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_suffix_order_on_drawn_strings():
    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 5, 20])) for _ in range(rng.randint(0, 60))]
        names = {x: i + 1 for i, x in enumerate(sorted(set(s)))}
        s = [names[x] for x in s] + [0]
        assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_order_on_bytes():
    b = b"the cat sat on the mat, the cat sat " * 20
    names = {x: i + 1 for i, x in enumerate(sorted(set(b)))}
    s = [names[x] for x in b] + [0]
    assert suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_string_order_and_equal_windows():
    rng = random.Random(4)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 3, 16, 17, 40]))) for _ in range(rng.randint(1, 30))]
        order, shared = string_order(strings)
        padded = [s.ljust(48, b"\0") for s in strings]
        assert [padded[i] for i in order] == sorted(padded) and shared[0] == -1
    for _ in range(100):
        n, window, core = rng.randint(1, 25), 20, 4
        key = np.array([rng.randint(0, 3) for _ in range(n)])
        low = np.array([rng.randint(0, 8) for _ in range(n)])
        high = np.array([rng.randint(a, 16) for a in low])
        left = [bytes(rng.choices(b"ab", [9, 1], k=h)) for h in high]
        right = [bytes(rng.choices(b"ab", [9, 1], k=window - core - a)) for a in low]
        got, seen = equal_windows(key, np.full(n, core), low, high, left, right, window), set()
        for i in range(n):
            for q in range(low[i], high[i] + 1):
                w = (key[i], q, left[i][:q], right[i][: window - core - q])
                assert got[i, q] == (w in seen)
                seen.add(w)


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert rows_of(op11_grouped_suffixes(spark, sf)) == brute(docs)


@pytest.mark.parametrize("crowd", [512, 2])
def test_edge_cases_and_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "CHUNK_CROWD", 1)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, near = word(300), word(500)
    rows = [(i, word(rng.randint(0, 150)) + passage + word(rng.randint(0, 150))) for i in range(40)]
    for i in range(40, 60):  # near copies, a letter changed
        at = rng.randint(0, 499)
        rows.append((i, near[:at] + rng.choice("xyz") + near[at + 1 :]))
    rows += [(60 + i, passage) for i in range(5)] + [(70, "a" * 99), (71, "a" * 100), (72, "a" * 350), (73, "ab" * 300), (74, "äöü" * 80), (75, None), (76, ""), (77, " " * 120)]
    rows += [(None, passage + "tail"), (80, word(100)), (80, rows[-9][1])]
    rows += [(90, near), (90, near)]  # a repeated row
    rows += [(100, word(3 * repeats.BLOCK) + passage), (101, rows[-1][1])]
    long = rows[-2][1]
    rows[-1] = (101, "x" + long[10:])
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA).repartition(7)
    got = rows_of(cut_repeats(df))
    # of different texts with one doc_id any may be first: 80 has a short text that meets nothing
    assert got == brute(rows)


def test_empty_table(spark):
    assert cut_repeats(spark.createDataFrame([], SCHEMA)).count() == 0

import random
import re

import numpy as np
import pytest

from calibra.llm import jaccard
from calibra.llm.common import table
from calibra.llm.jaccard import near_duplicates, op4_grouped_prefix_join, prefix_length

SCHEMA = "doc_id long, text string, n int, pivot string"


def sets(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def plain(rows, size, percent):
    items = [(d, sets(t, size)) for d, t in rows]
    parent = {d: d for d, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(s), root(d)) for d, s in items)


def test_prefix_length():
    assert [prefix_length(n, 85) for n in (1, 6, 7, 20, 100)] == [1, 1, 2, 4, 16]


@pytest.mark.parametrize("common_df, dense", [(3, 200), (1000, 200), (3, 0), (1000, 10)])
def test_against_all_pairs(spark, monkeypatch, common_df, dense):
    monkeypatch.setattr(jaccard, "COMMON_DF", common_df)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    base = [rnd.choice(vocabulary) for _ in range(60)]
    for _ in range(70):  # near copies of one text, many too far apart from each other
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append(" ".join(words))
    for _ in range(60):  # a passage that many share
        rows.append(" ".join([rnd.choice(vocabulary) for _ in range(rnd.choice([2, 15, 40]))] + passage))
    for _ in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 30))]
        rows += [" ".join(words), " ".join(words).upper(), " ".join([*words, "x"])]
    rows += [None, "", " \t", "one two", "ONE two", "x " * 5000, "x " * 5001] + rows[:30]
    rnd.shuffle(rows)
    table_ = [(3 * i + 1, t) for i, t in enumerate(rows)]
    got = near_duplicates(spark.createDataFrame([(d, t, 1, "z") for d, t in table_], SCHEMA), 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(table_, 4, 85)


def test_differences_keep_every_link():
    rnd, common = random.Random(5), np.packbits(np.zeros(jaccard.COMMON_BITS, bool), bitorder="little")
    links = 0
    for percent in (80, 85):
        c = (100 - percent) / (100 + percent)
        for _ in range(60):
            p = set(rnd.sample(range(1, 400), rnd.randint(30, 60)))
            edited = [p ^ set(rnd.sample(sorted(p), rnd.randint(0, 6))) ^ set(rnd.sample(range(400, 412), rnd.randint(0, 8))) for _ in range(12)]
            arrays = [np.array(sorted(v), np.uint64) << np.uint64(20) for v in (p, *edited)]
            late = np.array(rnd.sample(range(1, 412), 40), np.uint64) << np.uint64(20)
            far = [len(e ^ p) > c * (len(e) + len(p)) for e in edited]
            kept = [jaccard.differences(s, arrays[0], o, percent, common, late)[1].tolist() for s, o in zip(arrays[1:], far, strict=True)]
            for i, x in enumerate(edited):
                for j, y in enumerate(edited[:i]):
                    if (far[i] or far[j]) and 100 * len(x & y) >= percent * len(x | y):
                        links += 1
                        assert set(kept[i]) & set(kept[j])
    assert links > 100


def test_edges(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(5, "a b c d e f", 1, ""), (5, "a b c d e f", 1, ""), (2, "a b c d e f", 1, ""), (None, "a b c d e f", 1, ""), (None, None, 1, ""), (7, "other words than these ones here", 1, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(5, 2, 2), (5, 2, 2), (2, 2, 2), (None, 2, 2), (None, 0, None), (7, 2, 7)], key=str)


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert sorted(tuple(r) for r in op4_grouped_prefix_join(spark, sf).collect()) == plain(rows, 4, 85)

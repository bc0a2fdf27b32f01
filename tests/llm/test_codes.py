import hashlib

import numpy as np

from calibra.llm.codes import compress, decode, nearest_entries, op13_exponion_codes, part_edges, printed
from calibra.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, label string, x int, code int"


def brute(rows, rounds=6):
    """Every part against every entry, in Python's integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    x = [[int(np.floor(4096 * float(c))) for c in v] for _, v, _ in rows]
    edges = part_edges(len(x[0]))
    parts = [[tuple(v[a:b]) for v in x] for a, b in zip(edges, edges[1:])]
    books = [own[:16] for own in parts]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for p, own in enumerate(parts):
            to = {}
            for part in own:
                to.setdefault(nearest(part, books[p])[1], []).append(part)
            books[p] = [tuple(sum(c) // len(to[i]) for c in zip(*to[i])) if i in to else entry for i, entry in enumerate(books[p])]
    found = [[nearest(own[i], books[p]) for p, own in enumerate(parts)] for i in range(len(rows))]
    coded = [("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f)) for f in found]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return sorted(((r[0], r[2], c, e) for r, (c, e) in zip(rows, coded)), key=str), text


def test_whole_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, None if r.label is None else str(r.label)) for r in table(spark, sf, "embeddings").collect()]
    want, text = brute(rows)
    got = op13_exponion_codes(spark, sf).collect()
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    sha = hashlib.sha256(text.encode()).hexdigest()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, c, e, by_label[label], sha) for i, label, c, e in want), key=str)


def test_search_from_any_entry_with_ties():
    rng = np.random.default_rng(3)
    for _ in range(200):
        book = rng.integers(-4, 5, (rng.integers(1, 17), 2))
        x = rng.integers(-6, 7, (50, 2))
        all_d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        entry, d = nearest_entries(x, book, rng.integers(0, len(book), 50))
        assert (entry == all_d.argmin(axis=1)).all() and (d == all_d.min(axis=1)).all()


def test_edge_cases(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in rng.integers(-3, 4, 11) / 8], rng.choice(["a", "b", None])) for i in range(60)]
    good += [(7, good[9][1], "a"), (None, good[3][1], None), (70, good[4][1], "b"), (71, good[4][1], "b")]
    bad = [(80, None, "a"), (81, [1.0] * 10 + [None], "a"), (82, [float("nan")] * 11, "b"), (83, [float("inf")] * 11, "b"), (84, [1.0], "a"), (85, [], None)]
    df = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in good + bad], SCHEMA).repartition(3)
    coded, books = compress(df)
    want, text = brute(good)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in coded.collect()), key=str) == want and printed(books) == text
    some = {r.vec_id: r for r in coded.collect()}[70]
    exact = np.floor(4096 * np.array(good[-2][1]))
    assert ((decode([some.code], books)[0] - exact) ** 2).sum() == some.error
    few, books = compress(df.filter("vec_id < 3"))
    assert few.count() == 3 and all(len(b) == 3 for b in books) and all(r.error == 0 for r in few.collect())
    none, books = compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and books == []
    assert compress(spark.createDataFrame([(1, [], "a", 1, 1)], SCHEMA))[0].count() == 0

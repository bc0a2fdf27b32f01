import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from calibra.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, domain string, epoch string"


def share(nodes, budget):
    """nodes: name -> (weight, capacity). Fills in rounds: what a full child cannot take is shared anew."""
    got, open_ = {n: 0.0 for n in nodes}, {n for n, (w, c) in nodes.items() if w > 0}
    while open_ and budget > 1e-9:
        weights = sum(nodes[n][0] for n in open_)
        full = {n for n in open_ if got[n] + budget * nodes[n][0] / weights >= nodes[n][1] - 1e-9}
        if not full:
            for n in open_:
                got[n] += budget * nodes[n][0] / weights
            break
        for n in full:
            budget -= nodes[n][1] - got[n]
            got[n] = nodes[n][1]
        open_ -= full
    return got


def plain(rows, weights, part, epochs, seed):
    leaves = defaultdict(list)
    for d, t, lang, source, domain, _ in rows:
        leaves[domain or "unknown", lang or "unknown", source or "unknown"].append((d, len((t or "").split())))
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    cap = {k: supply[k] * epochs if w("source", k[2]) else 0 for k in leaves}
    lang_cap = defaultdict(int)
    for k in leaves:
        lang_cap[k[:2]] += cap[k]
    dom_cap = defaultdict(int)
    for k, c in lang_cap.items():
        dom_cap[k[0]] += c if w("lang", k[1]) else 0
    doms = share({d: (w("domain", d), c) for d, c in dom_cap.items()}, int(sum(supply.values()) * part))
    out = defaultdict(int)
    for d, budget in doms.items():
        langs = share({k[1]: (w("lang", k[1]), c) for k, c in lang_cap.items() if k[0] == d}, budget)
        for lang, b in langs.items():
            for source, target in share({k[2]: (w("source", k[2]), cap[k]) for k in leaves if k[:2] == (d, lang)}, b).items():
                docs, have, target = leaves[d, lang, source], supply[d, lang, source], int(target + 1e-6)
                whole = target // have if have else 0
                for doc, n in docs:
                    for e in range(whole):
                        out[doc, e, n, n] += 1
                rest, before = target - whole * have, 0
                place = lambda x: (int(hashlib.md5(f"{seed}:{whole}:{'null' if x[0] is None else x[0]}".encode()).hexdigest()[:15], 16), x)  # noqa: E731, B023
                for doc, n in sorted(docs, key=place):
                    if before < rest:
                        out[doc, whole, n, min(n, rest - before)] += 1
                    before += n
    return dict(out)


def test_against_plain_python(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4 if i % 2 else 0], ["x", "y", None][i // 120], "e") for i in range(300)]
    rows += [(7, "again seven", "en", "a", "x", None)] * 2 + [(1000, "one " * 5000, "en", "b", "y", None), (1001, None, "fr", "z", "y", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for buckets in (4096, 5):
        monkeypatch.setattr("calibra.llm.mixing.BUCKET_ROWS", buckets)
        for part, epochs, weights in ((0.7, 2, {"domain": {"x": 3}, "lang": {"en": 4}}), (1.4, 3, {}), (0.05, 1, {"source": {"a": 0}}), (9.0, 2, {})):
            got = defaultdict(int)
            for r in mix(docs, weights, part, epochs, 5).collect():
                got[r.doc_id, r.epoch, r.n_tokens, r.take_tokens] += 1
            assert dict(got) == plain(rows, weights, part, epochs, 5), (buckets, part)


def test_budget_is_met_and_columns_stay(spark):
    docs = spark.createDataFrame([(i, "word " * 10, "en", f"s{i % 3}", i) for i in range(90)], "doc_id long, text string, lang string, source string, n_chars int")
    got = mix(docs, {"source": {"s0": 2}}, 0.5, 1, 1)
    assert set(docs.columns) < set(got.columns) and got.agg(F.sum("take_tokens")).first()[0] in range(440, 451)
    assert mix(docs.limit(0), {}, 0.5, 1, 1).count() == 0

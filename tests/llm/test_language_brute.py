"""The language query against rank orders and out-of-place distances by hand."""

import unicodedata
import zlib
from collections import Counter, defaultdict

from calibra.llm.common import table
from calibra.llm.language import RANKS, TOP, identify, op5_rank_profiles, profiles_of


def grams(text):
    """One to three letters or word edges; a shorter one comes before those that begin with it."""
    kinds = [unicodedata.category(c)[0] for c in text.lower()]
    if "L" not in kinds:
        return Counter()
    points = [0]
    for c, kind in zip(text.lower(), kinds):
        if kind in "LM":
            points.append(ord(c))
        elif points[-1]:
            points.append(0)
    if points[-1]:
        points.append(0)
    out = Counter((p,) for p in points if p)
    out.update(zip(points, points[1:]))
    out.update(t for t in zip(points, points[1:], points[2:]) if t[1])
    return out


def ranked(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


def by_hand(rows):
    """rows(doc_id, text, lang): the predicted language and score of each."""
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if lang is not None and text is not None and zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5:
            counts[lang].update(grams(text))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c, RANKS))} for lang, c in counts.items() if c}
    out = []
    for doc_id, text, _ in rows:
        own = ranked(grams(text or ""), TOP)
        if not own or not profiles:
            out.append((doc_id, "und", 0.0))
            continue
        far = {lang: sum(min(abs(p[g] - i), RANKS) if g in p else RANKS for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((doc_id, best, round(1 - far[best] / (RANKS * len(own)), 12)))
    return sorted(out, key=str)


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, sf, "documents").collect()]
    got = op5_rank_profiles(spark, sf).collect()
    assert sorted(((r.doc_id, r.lang_pred, round(r.score, 12)) for r in got), key=str) == by_hand(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_ties_marks_and_long_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abab", "y"), ("abab", "x"), ("baba", "x"), ("ba ba", "y"), ("ÉA été", "f"), ("éa ́ b", "f"), ("日本 語", "j"), ("abab " * 100_000 + "zq", None), ("q", None), ("́", "x"), ("", "y"), (None, "x"), ("İstanbul ΣΑΣ", "x")] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, profiles_of(docs)).collect()
    assert sorted(((r.doc_id, r.lang_pred, round(r.score, 12)) for r in got), key=str) == by_hand(rows)

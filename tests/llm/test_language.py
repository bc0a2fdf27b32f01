import zlib
from collections import Counter

from pyspark.sql import functions as F

from calibra.llm.common import table
from calibra.llm.language import gram_counts, identify, letters, op5_rank_profiles, profiles_of


def plain(text):
    """n-grams of one to three by hand."""
    s = "_"
    for c in text.lower():
        s += c if c.isalpha() else "_"
    s += "_"
    while "__" in s:
        s = s.replace("__", "_")
    grams = Counter(c for c in s if c != "_")
    grams.update(s[i : i + 2] for i in range(len(s) - 1))
    grams.update(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != "_")
    return sorted(grams.values())


def test_grams_against_plain_python(monkeypatch):
    for chunk in (1 << 20, 7):
        monkeypatch.setattr("calibra.llm.language.CHUNK", chunk)
        for text in ("the cat, the hat.", "a", "É!!", "ab", "one two 3 four", "x y z"):
            assert sorted(gram_counts(letters(text))[1]) == plain(text), text
    assert len(letters("12 !?")) == 0


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = op5_rank_profiles(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert found.n > 150 and found.a > 0.95


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    rows = [(1, "the cat and the dog and the house", "en", "s", 1), (2, "der Hund und die Katze und das Haus", "de", None, 2), (3, None, "en", "", 3), (4, " 12 !", None, "", 4), (None, "das ist der Hund", None, "", 5), (6, "the the cat " * 50_000, "en", "", 6), (6, "the the cat " * 50_000, "en", "", 6)]
    docs = spark.createDataFrame(rows, schema)
    got = identify(docs, profiles_of(docs))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == 7 and by[3].lang_pred == by[4].lang_pred == "und" and by[4].score == 0 and all(0 <= r.score <= 1 for r in by.values())
    learned = {lang for d, t, lang, *_ in rows if lang and t and zlib.crc32(str(d).encode()) % 5}
    assert by[6].lang_pred in learned
    none = spark.createDataFrame([], schema)
    assert identify(none, profiles_of(none)).count() == 0
    assert {r.lang_pred for r in identify(docs, profiles_of(none)).collect()} == {"und"}

"""N-grams by words in tasks against those by joins."""

from textloom.operators import langid

TEXTS = [(1, "en", "The cat, the\u00a0hat a@b.c x1 http://a.org/b Straße ÉCOLE"), (2, "de", "der Hund\tund die ﬁ İz 😀 a"), (3, "en", ""), (4, None, "the dog"), (5, "de", None), (6, "de", "4 5 6 ##"), (7, "fr", "l'été à l'école\nΣΑΣ"), (1, "fr", "le chat")]


def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, lang string, text string").repartition(3)


def test_group_counts_equal_gram_counts(spark, monkeypatch):
    monkeypatch.setattr(langid, "_REMEMBERED", 2)
    for sizes in ((3,), (1, 2, 3), (1, 2)):
        assert sorted(map(str, langid.group_gram_counts(docs(spark), "lang", sizes=sizes).collect())) == sorted(map(str, langid.gram_counts(docs(spark), "lang", sizes=sizes).collect()))


def test_scores_of_words_equal_those_of_joins(spark, monkeypatch):
    for sizes in ((3,), (1, 2, 3)):
        profiles = langid.fit_profiles(docs(spark), min_count=1, sizes=sizes).localCheckpoint()
        monkeypatch.setattr(langid, "PROFILE_ROWS", 1_000_000)
        words = langid.detect_all(docs(spark), profiles, threshold=-1.0, sizes=sizes)
        # no n-gram of a document meets a profile in a join
        assert "Join" not in words._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.doc_id, r.lang): r.log_p for r in words.collect()}
        monkeypatch.setattr(langid, "PROFILE_ROWS", 1)
        joined = {(r.doc_id, r.lang): r.log_p for r in langid.detect_all(docs(spark), profiles, threshold=-1.0, sizes=sizes).collect()}
        assert got.keys() == joined.keys() and len(got) == 12
        assert all(abs(got[k] - joined[k]) < 1e-9 for k in got)

"""Vectors of hashed n-grams against those of Spark's own transformers."""

from pyspark.sql import functions as F

from textloom.operators import langid

TEXTS = ["The cat, the\u00a0hat a@b.c x1 http://a.org/b Straße ÉCOLE", "a", "", None, "4 5", "a b", "ab", "x y z yy x y", "İz 😀 l'été  -  ΣΑΣ 𝒳𝒴 漢字", "B", "one two  two one\tone two"]


def test_vectors_equal_those_of_hashing_tf(spark, monkeypatch):
    from pyspark.ml.feature import HashingTF, SQLTransformer

    monkeypatch.setattr(langid, "_REMEMBERED", 5)
    docs = spark.createDataFrame(list(enumerate(TEXTS * 3)), "id int, text string").coalesce(2)
    grams = "flatten(transform(sequence(2, 4), n -> transform(sequence(1, greatest(size(_c) - n + 1, 1)), i -> array_join(slice(_c, i, n), ''))))"
    text = "concat(' ', trim(regexp_replace(lower(coalesce(text, '')), '[^\\\\p{L}]+', ' ')), ' ')"
    cut = SQLTransformer(statement=f"SELECT *, transform(array(split({text}, '')), _c -> {grams})[0] AS _grams FROM __THIS__").transform(docs)
    for buckets in (1 << 14, 50):
        want = {r.id: r.v for r in HashingTF(inputCol="_grams", outputCol="v", numFeatures=buckets).transform(cut).select("id", "v").collect()}
        got = {r.id: r.v for r in docs.select("id", langid.hashed_ngrams(F.col("text"), buckets).alias("v")).collect()}
        assert got == want

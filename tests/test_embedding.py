import numpy as np
from pyspark.sql import functions as F

from textloom.operators import embedding, registries


def test_registries(spark):
    assert registries.languages(spark).count() == 60
    got = spark.createDataFrame([("NNS",), ("??",)], "t string").select(registries.universal_tag(F.col("t")).alias("u")).collect()
    assert [r.u for r in got] == ["NOUN", "X"]
    own = {"xx": {"a", "b"}, "en": {"harbour"}}
    assert registries.stop_words("xx", own) == {"a", "b"} and registries.stop_words("yy") == frozenset() and {"the", "harbour"} <= registries.stop_words("en", own)
    assert registries.stop_word_table(spark, own).where("lang = 'xx'").count() == 2


def test_labels_come_near_their_words(spark):
    rows = [(["cat", "dog", "cow"], ["animal"]), (["red", "blue", "pink"], ["colour"]), (["run", "jump", "swim"], ["motion"])] * 40
    df = spark.createDataFrame(rows, "words array<string>, labels array<string>").coalesce(1)
    made = {(r.side, r.term): np.array(r.vector) for r in embedding.rank_embedding(df, dim=16, epochs=4, rate=0.1, margin=0.2, negatives=4).collect()}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    for words, (label,) in rows[:3]:
        mean = np.mean([made["words", w] for w in words], axis=0)
        assert max(("animal", "colour", "motion"), key=lambda x: cos(mean, made["labels", x])) == label


def test_tuned_classifier(spark):
    rows = [(float(k % 2), ["good", "fine"] if k % 2 else ["bad", "poor"]) for k in range(60)]
    df = spark.createDataFrame(rows, "y double, words array<string>")
    best = embedding.tuned_classifier(df, "y", buckets=(64,), penalties=(1e-3, 1e-1))
    assert best.transform(df).where("y = prediction").count() == 60

"""What the topic model reads in its iterations."""

from pyspark.sql import functions as F

from textloom.operators import vectors


def test_documents_are_not_read_in_every_iteration(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        seen.add(1)
        return text.split(" ")

    rows = [(i, "cat dog cat" if i % 2 else "sun moon sky") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", cut("text").alias("words"))
    model = vectors.fit_topics(docs, topics=2, iterations=6)
    # once for the vocabulary (twice, as its filter counts too) and once for the counts
    assert seen.value <= 3 * len(rows)
    assert {r.topic for r in vectors.describe_topics(model, 2).collect()} == {0, 1}
    assert model.transform(docs).select("topics").count() == len(rows)

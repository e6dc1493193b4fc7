"""What batches of a stream keep, held against all documents at once."""

import random

from pyspark.sql import functions as F

from textloom.operators import pii, stats
from textloom.streaming import streams


def documents(n, seed=3):
    draw = random.Random(seed)
    return [(d, " ".join(draw.choices(["red", "sea", "old", "town", "of", "the"], k=draw.randrange(1, 30)))) for d in range(n)]


def test_collocations_of_batches_equal_those_of_all(spark, tmp_path):
    rows = documents(60)
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    for k, some in enumerate((rows[:7], rows[7:40], [], rows[40:])):
        streams.merge_collocations(frame(some), k, str(tmp_path))
    streams.merge_collocations(frame(rows[:7]), 0, str(tmp_path))  # tried again
    got = {(r.gram, r.n) for r in streams.merged_collocations(spark, str(tmp_path), 0.02, 0.06).collect()}
    assert got == {(r.gram, r.n) for r in stats.collocations(frame(rows), 3, 0.02, 0.06).collect()} and got


def test_names_stay_the_same_from_batch_to_batch(spark, tmp_path):
    def batch(texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return pii.Analyzer("en", [pii.EMAIL, pii.IP]).analyze(docs)

    batches = [["write to a@x.org or b@x.org"], ["c@x.org at 10.0.0.1", "again b@x.org"], ["nothing here"], ["10.0.0.1 and a@x.org and 10.0.0.2"]]
    answer = lambda df: df.withColumn("answer", F.concat(F.lit("re: "), "cloaked"))
    first = []
    for k, texts in enumerate(batches):
        rows = streams.cloak_batch(batch(texts), k, str(tmp_path), answer).orderBy("doc_id").collect()
        first.append([r.cloaked for r in rows])
        assert [r.rehydrated for r in rows] == ["re: " + t for t in texts]
    assert first[0] == ["write to EMAIL_ADDRESS_1 or EMAIL_ADDRESS_2"]
    assert first[1] == ["EMAIL_ADDRESS_3 at IP_ADDRESS_1", "again EMAIL_ADDRESS_2"]
    assert first[3] == ["IP_ADDRESS_1 and EMAIL_ADDRESS_1 and IP_ADDRESS_2"]
    again = streams.cloak_batch(batch(batches[1]), 1, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.cloaked for r in again] == first[1]


def test_items_that_are_short_or_begin_inside_words(spark):
    docs = spark.createDataFrame([(1, "a smart of war man said hello world"), (2, "Hello World"), (3, "the art of war now"), (4, "xx one two three four five sixyy"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "art of war"), (2, "hello world"), (3, "One two three four five six"), (4, "x one two three four five s"), (5, None), (6, "one two three four five seven")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in stats.appearances(docs, items).collect())
    assert got == [(1, 1), (1, 2), (2, 2), (3, 1), (4, 3), (4, 4)]

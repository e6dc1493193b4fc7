"""Dictionary entries as features of the entity tagger: where only the dictionary tells a name, it has to be read."""

import random

from pyspark.sql import functions as F

from textloom.operators import perceptron, spot
from textloom.plans import pipeline


def corpus(names, n, seed):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        name = draw.choice(names).split()
        words = draw.choices(["we", "saw", "a", "thing", "there"], k=draw.randrange(2, 6))
        at = draw.randrange(len(words) + 1)
        kind = ["U-P"] if len(name) == 1 else ["B-P", *["I-P"] * (len(name) - 2), "L-P"]
        rows.append((k, words[:at] + name + words[at:], ["O"] * at + kind + ["O"] * (len(words) - at)))
    return rows


def random_names(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(3))
    return [" ".join(word() for _ in range(draw.choice([1, 2, 3]))) for _ in range(n)]


def test_kinds_of_entries_return_to_their_words(spark):
    entries = spot.dictionary(spark.createDataFrame([("new york", "P"), ("york", "Q"), ("new york city", "P"), ("a", "R")], "entry string, type string"))
    df = spark.createDataFrame([(1, ["In", "New", "York", "a", "York"]), (2, []), (3, None), (1, ["new", "york", "city"])], "doc_id long, words array<string>")
    got = sorted(((r.doc_id, r.words, r.known) for r in spot.known_types(df, entries).collect()), key=repr)
    assert got == sorted([(1, ["In", "New", "York", "a", "York"], [[], ["P"], ["P"], ["R"], ["Q"]]), (2, [], []), (3, None, None), (1, ["new", "york", "city"], [["P"], ["P"], ["P"]])], key=repr)


def test_the_dictionary_tells_names_never_seen(spark):
    seen, new, plain = random_names(60, 1), random_names(60, 2), random_names(60, 3)
    train, held = corpus(seen, 200, 4), corpus(new, 60, 5)
    # unknown words that are no names, in the same places
    for rows, seed in ((train, 6), (held, 7)):
        draw = random.Random(seed)
        for _, words, tags in rows:
            other = draw.choice(plain).split()
            words += other
            tags += ["O"] * len(other)
    entries = spot.dictionary(spark.createDataFrame([(x, "PLACE") for x in seen + new], "entry string, type string"))
    frame = lambda rows: spot.known_types(spark.createDataFrame(rows, "doc_id long, words array<string>, tags array<string>"), entries)

    def score(known):
        model = perceptron.fit_tagger(frame(train), epochs=4, known_col=known)
        made = perceptron.tag(frame(held), model, into="got", entities=True, known_col=known)
        right = made.select(F.explode_outer(F.arrays_zip(F.col("tags").alias("g"), F.col("got").alias("t"))).alias("p")).where("p.g <> 'O'")
        return right.agg(F.avg((F.col("p.g") == F.col("p.t")).cast("double"))).first()[0]

    with_, without = score("known"), score(None)
    assert with_ > 0.9 and with_ > without + 0.2


def test_stage_with_a_gazetteer(spark):
    train = spot.known_types(spark.createDataFrame(corpus(random_names(60, 1), 200, 4), "doc_id long, words array<string>, tags array<string>"), spot.dictionary(spark.createDataFrame([(x, "P") for x in random_names(60, 1)], "entry string, type string")))
    model = perceptron.fit_tagger(train, epochs=4, known_col="known")
    entries = spot.dictionary(spark.createDataFrame([("zuzu zaza", "P")], "entry string, type string"))
    stages = pipeline.Pipeline().add(pipeline.fast_tokenizer()).add(pipeline.entity_tagger(model=model, gazetteer=entries))
    docs = spark.createDataFrame([(1, "we saw zuzu zaza there"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.entities for r in stages.transform(docs).collect()}
    assert [(e.start, e.end, e.entity_type) for e in got[1]] == [(7, 15, "P")] and not got[2]

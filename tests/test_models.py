import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textloom.operators import langid, lexicon, perceptron, vectors
from textloom.operators.patterns import Pattern, Unit
from textloom.plans import pipeline as P
from textloom.sources import readers
from textloom.streaming import streams


def test_tagger_and_entities(spark):
    gold = [(["the", "dog", "runs"], ["DET", "NOUN", "VERB"]), (["a", "cat", "sleeps"], ["DET", "NOUN", "VERB"]), (["dogs", "run"], ["NOUN", "VERB"])] * 10
    df = spark.createDataFrame(gold, "words array<string>, tags array<string>").coalesce(2)
    model = perceptron.fit_tagger(df, epochs=4)
    got = perceptron.tag(df.select("words", F.col("tags").alias("gold")), model).collect()
    assert sum(a == b for r in got for a, b in zip(r.tags, r.gold, strict=True)) >= 0.95 * sum(len(r.gold) for r in got)
    back = perceptron.Weights.from_rows(model.to_rows(spark))
    assert back.best(perceptron.token_features(["the", "dog"], 0, "<s>", "<s>")) == "DET"
    names = [(["Ann", "Lee", "met", "Bob"], ["B-PER", "L-PER", "O", "U-PER"])] * 10
    ner = perceptron.fit_tagger(spark.createDataFrame(names, "words array<string>, tags array<string>").coalesce(1))
    tags = perceptron.tag(spark.createDataFrame([(["Ann", "Lee", "met", "Bob"],), (["Ann"],), ([],)], "words array<string>"), ner, entities=True).collect()
    assert tags[0].tags == ["B-PER", "L-PER", "O", "U-PER"] and tags[1].tags[0][0] in "UO" and tags[2].tags == []


def test_parser(spark):
    rows = [(["the", "dog", "runs"], ["DET", "NOUN", "VERB"], [1, 2, -1]), (["she", "sees", "a", "cat"], ["PRON", "VERB", "DET", "NOUN"], [1, -1, 3, 1])] * 8
    df = spark.createDataFrame(rows, "words array<string>, tags array<string>, heads array<int>").coalesce(2)
    got = perceptron.parse(df.withColumnRenamed("heads", "gold"), perceptron.fit_parser(df)).collect()
    assert all(r.heads == r.gold for r in got)
    flags = perceptron.is_projective(perceptron.is_verb_root(spark.createDataFrame([(["VERB", "X", "X", "X"], [-1, 3, 0, 0]), (["X", "VERB"], [1, -1])], "tags array<string>, heads array<int>"))).collect()
    assert [(r.verb_root, r.projective) for r in flags] == [(True, False), (True, True)]


def test_language_detectors(spark):
    draw = random.Random(1)
    make = lambda letters: " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 7))) for _ in range(30))
    rows = [(k, make("abcde" if k % 2 else "defgh"), "aa" if k % 2 else "bb") for k in range(60)] + [(90, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = {k: lang for k, _, lang in rows}
    got = langid.detect(docs, langid.fit_profiles(docs, min_count=1)).collect()
    assert len(got) == 61 and all((known[r.doc_id] or "und") == r.lang for r in got)
    model = langid.fit_linear_detector(docs.where("text is not null"))
    out = model.transform(docs.where("text is not null").withColumn("_label", F.lit(0.0))).collect()
    assert sum(known[r.doc_id] == r.prediction_lang for r in out) >= 58


def test_vectors(spark):
    draw = np.random.default_rng(3)
    data = draw.normal(size=(200, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(data)], "vec_id long, embedding array<double>")
    got = vectors.most_similar(df.where("vec_id % 50 = 0"), df, 5).collect()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in range(0, 200, 50):
        score = unit @ unit[q]
        score[q] = -9
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-score)[:5].tolist()
    turn = np.linalg.qr(draw.normal(size=(8, 8)))[0]
    pairs = spark.createDataFrame([(x.tolist(), (x @ turn).tolist()) for x in data], "source array<double>, target array<double>")
    w = vectors.align(pairs)
    assert np.allclose(w, turn)
    assert np.allclose(pairs.limit(1).select(vectors.translate(F.col("source"), w).alias("x")).first().x, pairs.first().target)
    assert df.limit(1).select(vectors.quantise(F.col("embedding")).alias("x")).first().x == np.where(np.array(df.first().embedding) >= 0, 1.0, -1.0).tolist()
    parts = spark.createDataFrame([("cats",)], "word string").select(vectors.subwords(F.col("word"), 3, 4, 1000).alias("p")).first().p
    assert len(parts) == 4 + 3 and all(0 <= p < 1000 for p in parts)
    sentences = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "doc_id long, ix int, vector array<double>")
    got = {r.ix: r.contribution for r in vectors.sentence_contributions(sentences, spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<double>")).collect()}
    assert got[0] > 0 > got[1]


def test_lexicon(spark, tmp_path):
    (tmp_path / "data.noun").write_text("  1 a licence line\n00001740 03 n 02 dog 0 domestic_dog 1 002 @ 00002000 n 0000 ~ 00003000 n 0000 | a pet\n00002000 03 n 01 animal 0 001 ~ 00001740 n 0000 | a living thing\n00003000 03 n 02 Puppy 0 pup 0 001 @ 00001740 n 0000 | young\n")
    words, pointers = lexicon.read_wordnet(spark, str(tmp_path))
    assert words.count() == 5 and pointers.count() == 4
    terms = spark.createDataFrame([("Dog",), ("puppy",), ("domestic dog",)], "term string")
    assert {(r.term, r.synonym) for r in lexicon.synonyms(terms, words).collect()} == {("Dog", "domestic_dog"), ("puppy", "pup"), ("domestic dog", "dog")}
    assert {(r.term, r.word) for r in lexicon.related(terms, words, pointers, "hypernym").collect()} == {("Dog", "animal"), ("domestic dog", "animal"), ("puppy", "dog"), ("puppy", "domestic_dog")}


def test_corpus_readers(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# text = It runs\n1\tIt\tit\tPRON\t_\t_\t2\tnsubj\t_\t_\n2\truns\trun\tVERB\t_\t_\t0\troot\t_\t_\n\n# text = Go\n1\tGo\tgo\tVERB\t_\t_\t0\troot\t_\t_\n")
    got = sorted(readers.read_conllu(spark, str(tmp_path / "a.conllu")).collect(), key=lambda r: r.sentence)
    assert [(r.text, r.words, r.tags, r.heads) for r in got] == [("It runs", ["It", "runs"], ["PRON", "VERB"], [1, -1]), ("Go", ["Go"], ["VERB"], [-1])]
    (tmp_path / "w.txt").write_text("Ann|N|I-PER Lee|N|I-PER met|V|O Bob|N|I-PER Rio|N|B-LOC x|N|I-MISC\n")
    assert readers.read_wikiner(spark, str(tmp_path / "w.txt")).first().tags == ["B-PER", "L-PER", "O", "U-PER", "U-LOC", "O"]
    (tmp_path / "p.json").write_text('{"name": "xx", "freq": {"a": 2, "ab": 1}, "n_words": [4, 2, 0]}')
    assert {(r.gram, r.p) for r in readers.read_language_profiles(spark, str(tmp_path / "p.json")).collect()} == {("a", 0.5), ("ab", 0.5)}
    (tmp_path / "d.txt").write_text("dog chien\ncat chat\ndog clebs\n")
    assert {(r.word, r.translation) for r in readers.read_bilingual(spark, str(tmp_path / "d.txt")).collect()} == {("dog", "chien"), ("cat", "chat")}


def test_pipeline_algebra(spark, tmp_path):
    p = P.Pipeline.for_language("en").add(P.personal_data("en", ["EMAIL_ADDRESS"])).add(P.lower_case())
    assert p.names() == ["clean", "lower_case", "fast_tokenizer", "rule_sentences", "personal_data"]
    assert p.has("clean") and not p.remove("clean").has("clean") and p.entity_types() == ["EMAIL_ADDRESS"]
    docs = spark.createDataFrame([(1, "Write to A@B.org, C#!", "en"), (2, "Schreib an A@B.org", "de"), (3, " \x01 \n", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in p.add_special_case("c#").transform(docs).collect()}
    assert "c#" in [t.value for t in got[1].tokens] and len(got[1].spans) == 1
    assert got[2].tokens is None and got[2].findings is None and got[3].tokens == []
    p.pack(spark, str(tmp_path / "p"))
    back = P.Pipeline.unpack(spark, str(tmp_path / "p"))
    assert (back.names(), back.lang, back.version) == (p.names(), "en", 0)
    n = P.Pipeline().add(P.personal_data(None, ["EMAIL_ADDRESS"])).add(P.neuralyzer({"EMAIL_ADDRESS": [Pattern("x").add(Unit().token("A@B.org"))]}, {"ORG": [Pattern("y").add(Unit().token("Schreib"))]}))
    assert [[f.entity_type for f in r.findings] for r in n.transform(docs).orderBy("doc_id").collect()] == [[], ["ORG"], []]


def test_rehydrated_chunks(spark, tmp_path):
    text = "Hello PERSON_1, mail EMAIL_1 or PERSON_12."
    names = {"PERSON_1": "Ann", "EMAIL_1": "ann@x.org", "PERSON_12": "Bob"}
    parts = [text[k : k + 2] for k in range(0, len(text), 2)]
    for batch in range(0, len(parts), 7):
        rows = [("s", batch + k, c) for k, c in enumerate(parts[batch : batch + 7])]
        if batch + 7 >= len(parts):
            rows.append(("s", 999, None))
        pd.DataFrame(rows, columns=["stream_id", "seq", "chunk"]).to_parquet(tmp_path / f"{batch:03}.parquet")
    chunks = spark.readStream.schema("stream_id string, seq long, chunk string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = streams.rehydrate_chunks(chunks, names).writeStream.format("memory").queryName("answers").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = "".join(r.text for r in spark.table("answers").orderBy("seq").collect())
    assert got == "Hello Ann, mail ann@x.org or Bob."


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "d"))
    stream = streams.running_term_counts(streams.read_documents(spark, str(tmp_path / "d"), "doc_id long, text string"))
    q = stream.writeStream.format("memory").queryName("terms").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.term, r.n) for r in spark.table("terms").collect()} == {("a", 2), ("b", 2), ("c", 1)}


def test_topics_are_fitted_on_all_documents(spark):
    draw = random.Random(2)
    rows = [(d, [f"{'ab'[d % 2]}{draw.randrange(30)}" for _ in range(40)]) for d in range(200)]
    model = vectors.fit_topics(spark.createDataFrame(rows, "doc_id long, words array<string>"), topics=2)
    assert model.stages[1].getSubsamplingRate() == 1
    for topic in (0, 1):
        assert len({r.term[0] for r in vectors.describe_topics(model).collect() if r.topic == topic}) == 1


def test_batches_tried_again_count_once(spark, tmp_path):
    counts = lambda *rows: spark.createDataFrame(rows, "term string, n long")
    for batch_id, batch in ((0, counts(("a", 2), ("b", 1))), (1, counts(("a", 5))), (1, counts(("a", 3), ("c", 1)))):
        streams.merge_counts(batch, batch_id, f"{tmp_path}/counts")
    assert {r.term: r.n for r in streams.merged_counts(spark, f"{tmp_path}/counts").collect()} == {"a": 5, "b": 1, "c": 1}


def test_ragged_vectors_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, []), (5, [1.0]), (6, None), (7, [0.5, 0.0]), (8, [4.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vectors.most_similar(df, df.repartition(3), 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got if r.query_id == 8) == [(8, 1, 0), (8, 2, 1)] and {r.query_id for r in got} == {0, 1, 2, 3, 7, 8}


def test_more_labels_than_a_thousand(spark):
    rows = [([f"f{k}"], f"label{k:04}") for k in range(1100)]
    model = perceptron.fit_perceptron(spark.createDataFrame(rows, "features array<string>, label string").coalesce(1), epochs=1)
    assert len(model.labels) == 1100


def test_gram_counts_equal_those_of_whole_texts(spark):
    docs = spark.createDataFrame([("a", "One two, a b ça 12x"), ("a", ""), ("b", None), ("b", "x")], "lang string, text string")
    whole = docs.select("lang", F.explode_outer(langid.char_ngrams(langid.normalised(F.col("text")), (1, 2, 3))).alias("gram")).where("gram is not null").groupBy("lang", "gram").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, langid.gram_counts(docs, "lang").collect())) == sorted(map(tuple, whole.collect()))


GOLD = [
    ("Ann saw the dog. It ran!", ["PROPN", "VERB", "DET", "NOUN", "PUNCT", "PRON", "VERB", "PUNCT"], [1, -1, 3, 1, 1, 6, -1, 6], ["U-PER", "O", "O", "O", "O", "O", "O", "O"]),
    ("Bob Lee saw a cat.", ["PROPN", "PROPN", "VERB", "DET", "NOUN", "PUNCT"], [1, 2, -1, 4, 2, 2], ["B-PER", "L-PER", "O", "O", "O", "O"]),
]


def gold_models(spark):
    words = lambda text: __import__("re").findall(r"\w+|[.!]", text)
    rows = [(words(t), tags, heads, ner) for t, tags, heads, ner in GOLD]
    each = []
    for w, tags, heads, ner in rows:
        cut = [0, *[k + 1 for k, x in enumerate(w) if x in ".!"]]
        each += [(w[a:b], tags[a:b], [h - a if h >= 0 else -1 for h in heads[a:b]], ner[a:b]) for a, b in zip(cut, cut[1:])]
    df = spark.createDataFrame(each * 8, "words array<string>, tags array<string>, heads array<int>, ner array<string>").coalesce(2)
    return perceptron.fit_tagger(df), perceptron.fit_tagger(df, tags_col="ner"), perceptron.fit_parser(df)


def test_sentence_tagger_entity_and_parser_stages(spark, tmp_path):
    tag_model, ner_model, arc_model = gold_models(spark)
    docs = spark.createDataFrame([(k, t, "en", tags, heads) for k, (t, tags, heads, _) in enumerate(GOLD)] + [(7, "Der Hund lief.", "de", None, None), (8, None, "en", None, None), (9, "", "en", None, None)], "doc_id long, text string, lang string, gold array<string>, gold_heads array<int>")
    made = P.Pipeline.for_language("en", tagger_model=tag_model).add(P.entity_tagger("en", model=ner_model)).add(P.parser("en", model=arc_model))
    made = made.add(P.pattern_spotter("SEEN", Pattern("p").add(Unit().pos("VERB"), Unit().pos("DET"), Unit().pos("NOUN")), lang="en")).add(P.pattern_spotter("WHO", Pattern("p").add(Unit().entity("PER").many()), lang="en"))
    assert made.names() == ["clean", "fast_tokenizer", "rule_sentences", "tagger", "entity_tagger", "parser", "spotter_SEEN", "spotter_WHO"] and made.entity_types() == ["PER", "SEEN", "WHO"]
    out = made.transform(docs)
    got = {r.doc_id: r for r in out.collect()}
    for k, (text, tags, heads, _) in enumerate(GOLD):
        assert got[k].tags == tags and got[k].heads == heads
        kinds = {(text[e.start : e.end + 1], e.entity_type) for e in got[k].entities}
        assert kinds == ({("Ann", "PER"), ("saw the dog", "SEEN"), ("Ann", "WHO")} if k == 0 else {("Bob Lee", "PER"), ("saw a cat", "SEEN"), ("Bob Lee", "WHO")})
    assert [(s.begin, s.end) for s in got[0].spans] == [(0, 15), (17, 23)]
    assert got[7].tokens is None and got[7].tags is None and got[7].text == "Der Hund lief." and got[8].tags == [] and got[9].tags == []
    scores = {r.tag: r for r in perceptron.tag_scores(out.where("gold is not null")).collect()}
    assert scores[None].f1 == 1.0 and scores["VERB"].actual == 3 and scores["VERB"].precision == 1.0
    arcs = perceptron.attachment_scores(out.where("gold is not null"), "gold_heads").first()
    assert (arcs.n_tokens, arcs.attached, arcs.n_roots, arcs.unlabelled, arcs.root_accuracy) == (14, 14, 3, 1.0, 1.0)
    packed = P.Pipeline.for_language("en", tagger_model=tag_model).add(P.parser("en", model=arc_model))
    packed.pack(spark, f"{tmp_path}/packed")
    back = P.Pipeline.unpack(spark, f"{tmp_path}/packed").transform(docs)
    assert {r.doc_id: (r.tags, r.heads) for r in back.collect()} == {k: (r.tags, r.heads) for k, r in got.items()}
    for version in (1, 2):
        P.store_model(spark, f"{tmp_path}/models", "tagger", "en", version, tag_model if version == 2 else ner_model)
    assert P.load_model(spark, f"{tmp_path}/models", "tagger", "en").labels == tag_model.labels
    assert P.load_model(spark, f"{tmp_path}/models", "tagger", "en", 1).labels == ner_model.labels


def test_special_cases_of_stages_reach_the_tokenizers(spark):
    docs = spark.createDataFrame([(1, "we like c++ (c#) here", "en"), (2, "wir z.B. c++", "de"), (3, "x", "xx")], "doc_id long, text string, lang string")
    made = P.Pipeline.for_many(["en", "de"]).add(P.pattern_spotter("CODE", Pattern("p").add(Unit().token("c++", "c#")), special_cases=("c++", "c#")))
    got = {r.doc_id: r for r in made.transform(docs).collect()}
    assert [t.value for t in got[1].tokens] == ["we", "like", "c++", "(", "c#", ")", "here"] and [t.value for t in got[2].tokens] == ["wir", "z.B.", "c++"]
    assert len(got[1].entities) == 2 and got[3].tokens is None

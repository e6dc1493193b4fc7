import random

import corpus_pipeline as C


def test_stages_keep_clean_documents_and_take_the_rest(spark, tmp_path):
    draw = random.Random(12)
    words = [f"w{i}" for i in range(800)]
    text = lambda n=80: " ".join(draw.choice(words) for _ in range(n))
    rows, labels = [], []
    for d in range(500):
        good = d % 5 != 0
        rows.append((d, text() if good else " ".join(w.upper() + "!!" for w in text().split())))
        labels.append((d, int(good), 0))
    items = [(k, text(30)) for k in range(5)]
    copies = [(1000 + k, rows[1][1]) for k in range(4)]
    near = [(1100 + k, " ".join([*rows[2][1].split()[:-1], f"x{k}"])) for k in range(3)]
    leaks = [(1200 + k, text(40) + " " + items[k][1] + " " + text(40)) for k in range(5)]
    odd = [(1300, None), (None, text()), (1301, "")]
    everything = rows + copies + near + leaks + odd
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in everything], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = C.table(spark, str(tmp_path), "documents")
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        docs = C.written(stage(spark, docs, str(tmp_path)), "test-stage")
        assert k == len(C.STAGES) - 1 or docs.columns == C.COLUMNS
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    after = list(kept.values())
    clean = {d for d in range(500) if d % 5}
    assert clean <= after[0] and not after[0] & {d for d in range(0, 500, 5)}
    assert after[1] & {1, *range(1000, 1004)} == {1} and after[1] & {2, *range(1100, 1103)} == {2} and clean <= after[1]
    assert not after[2] & set(range(1200, 1205)) and clean <= after[2]
    assert clean <= after[3] and after[4] == after[3]
    got = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == after[4]

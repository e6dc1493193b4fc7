import random

from textloom.llm import line_dedup as L


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_chars):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for k, x in enumerate(t.split("\n")):
            x = x.strip(L.BLANKS)
            if x:
                first.setdefault(x, (d, k))
    near = {x for x in first if len(x) >= min_chars and any(len(y) >= min_chars and first[y] < first[x] and one_edit(x, y) for y in first)}
    out = {}
    for d, t in rows:
        lines = (t.split("\n") if t is not None else [])
        trimmed = [x.strip(L.BLANKS) for x in lines]
        again = [k for k, x in enumerate(trimmed) if x and d is not None and first[x] != (d, k)]
        close = [k for k, x in enumerate(trimmed) if x and d is not None and k not in again and x in near]
        out[d, t] = len(lines), again, close
    return out


def corpus():
    draw = random.Random(8)
    letters = "ab é"
    pool = []
    for n in [5, 12, 19, 20, 21, 30, 48, 49, 60, 97, 150, 200, 400, 1500]:
        for _ in range(3):
            pool.append("x" + "".join(draw.choice(letters) for _ in range(n - 2)) + "y")
    pool += ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 31, "a" * 100, "a" * 99, "q" * 6000]

    def near(x):
        i, kind = draw.randrange(len(x)), draw.randrange(3)
        return x[:i] + draw.choice(["", "b", "é"]) + x[i + (kind > 0) :] if kind < 2 else x[:i] + "ab" + x[i:]

    rows = []
    for d in range(120):
        rows.append((d, "\n".join(draw.choice([lambda: draw.choice(pool), lambda: near(draw.choice(pool)), lambda: " ", lambda: near(near(draw.choice(pool)))])() for _ in range(draw.randrange(0, 6)))))
    rows += [(900, None), (901, ""), (902, " \n\t\n"), (None, rows[3][1] + "\nlost line of some length here"), (5, rows[5][1])]
    return rows


def test_equals_comparing_all_lines(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as line", "3 as n_lines")
    got = {(r.doc_id, r.row_key): (r.n_lines, list(r.repeated), list(r.near)) for r in L.line_decisions(docs).collect()}
    keys = {(r.doc_id, r.text): r.k for r in docs.selectExpr("*", "xxhash64(doc_id, text) as k").collect()}
    want = {(d, keys[d, t]): v for (d, t), v in brute(rows, 20).items()}
    assert got == want
    assert sum(len(v[2]) for v in want.values()) > 40
    text = {(r.doc_id, r.text) for r in L.dedup_lines(docs).collect()}
    for (d, t), (_, again, close) in brute(rows, 20).items():
        assert (d, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in again + close)) in text
    assert L.line_decisions(docs.limit(0)).count() == 0
    assert L.dedup_lines(docs.limit(0)).columns == docs.columns


def test_clashing_columns_very_long_texts_and_shared_ids(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line + "\n" + "x" * 300_000), (1, "first\n" + line), (2, "\n".join(f"row {k} of a text with very many rows" for k in range(5000)) + "\n" + line), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _row", "2 as _gone", "3 as _id", "4 as row_key")
    got = L.dedup_lines(docs)
    assert got.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text) for r in got.collect())
    assert all(r._row == 1 and r._gone == 2 and r._id == 3 for r in got.collect())
    assert sum(line in t for _, t in left) == 2 and left[0] == (0, line) and len(left) == 4
    assert L.dedup_lines(docs.limit(0)).count() == 0

"""N-gram Jaccard join (5), line dedup (10), the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tabforge.llm import components as K
from tabforge.llm import linededup as N
from tabforge.llm import sigtree as J
from tabforge.session import written


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def near_texts(rng, n):
    vocab = [f"w{i}" for i in range(200)]
    hot = [rng.choice(vocab) for _ in range(60)]
    out = [None, "", " \n", "One two", "one TWO", "one two three four five", "Élan élan"]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(5, 120))] for _ in range(6)]
    while len(out) < n:
        kind = rng.random()
        words = list(bases[0] if kind < 0.5 else rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = [rng.choice(vocab)]
        if kind > 0.9:
            words += hot
        out.append(" ".join(words))
    return out


def test_tree_join_finds_all_links():
    rng = random.Random(1)
    for _ in range(6):
        texts = near_texts(rng, 120)
        sets = [J.shingle_set(t) for t in texts]
        root = list(range(len(texts)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in J.tree_join(sets):
            x, y = sorted((find(a), find(b)))
            root[y] = x
        want, sizes = brute_components(texts)
        assert [find(i) for i in range(len(texts))] == want and sizes == [len(s) for s in sets]


@pytest.mark.parametrize("tile,block,rounds", [(800, 400, 6), (10, 5, 0), (30, 7, 1)])
def test_components_match_brute_force(spark, monkeypatch, tile, block, rounds):
    for name, v in (("TILE", tile), ("BLOCK", block), ("ROUNDS", rounds), ("GROUP_ROWS", 20)):
        monkeypatch.setattr(J, name, v)
    texts = near_texts(random.Random(tile), 150)
    docs = spark.createDataFrame([(i, t, b"x", 1) for i, t in enumerate(texts)], "doc_id long, text string, cls binary, n int").repartition(4)
    got = {r.doc_id: r for r in J.jaccard_components(docs).collect()}
    root, sizes = brute_components(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == root
    kept = {r.doc_id for r in J.keep_one(docs).collect()}
    assert kept == {r for r in root}


def test_join_edges(spark):
    docs = spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "a b"), (None, "c d"), (3, None), (3, None), (5, "z")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(None, 1, 2), (2, 1, 2), (2, 1, 2), (None, 1, None), (3, 0, 3), (3, 0, 3), (5, 1, 5)], key=str)
    assert sorted(((r.doc_id, r.text) for r in J.keep_one(docs).collect()), key=str) == sorted([(None, "a b"), (None, "c d"), (3, None), (3, None), (5, "z")], key=str)
    assert J.jaccard_components(docs.limit(0)).collect() == [] and J.keep_one(docs.limit(0)).collect() == []


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(200, 200), (100, 101), (101, 100)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in K.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: r for x, r in root.items() if any(a != b for a, b in edges if x in (a, b))}
    assert got == root


def brute_lines(rows, width=3):
    """(lines with a word, removed ones, text) by scanning in order of id."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        lines = (text or "").split("\n")
        kept = [j for j, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        body = [lines[j] for j in kept]
        spans = [(a, a + width) for a in range(len(body) - width + 1)] if len(body) >= width else [(0, len(body))] if body else []
        drop = set()
        for a, b in spans:
            if first.setdefault(tuple(body[a:b]), (i, a)) != (i, a):
                drop.update(range(a, b))
        gone = {kept[j] for j in drop}
        new = text if not drop else "" if len(drop) == len(body) else "\n".join(x for j, x in enumerate(lines) if j not in gone)
        out[i] = (len(body), sorted(drop), new)
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(3)
    pool = ["alpha", "beta x", "gamma", "", "  ", "Δ", "end\r", "a\x85b"]
    rows = [(i, None if i == 5 else "\n".join(rng.choice(pool) + (str(rng.randint(0, 9)) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 12)))) for i in range(150)]
    rows += [(200, "y\n" * 40), (201, "a1\nb2\nc3\nd4\ne5"), (202, "q\na1\nb2\nc3\nd4\ne5\nr"), (203, "only"), (204, "only")]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, n_removed int, extra string").repartition(4)
    got = {r.doc_id: r for r in N.dedup_lines(docs).collect()}
    for i, (n, drop, text) in brute_lines(rows).items():
        r = got[i]
        assert (r.n_lines, r.n_removed, r.removed, r.text, r.extra) == (n, len(drop), drop, text, "k")
    assert got[202].text == "q\nr" and got[204].text == ""
    # every removed line stands somewhere still
    left = {x for r in got.values() for x in (r.text or "").split("\n")}
    assert {x for _, t in rows for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")} <= left


def test_line_edges(spark):
    docs = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_removed) for r in N.dedup_lines(docs).collect()), key=str)
    assert got == sorted([(None, "a\nb\nc", 0), (1, "", 3), (1, "", 3), (2, None, 0), (3, "", 0)], key=str)
    assert N.dedup_lines(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, sf):
    from tabforge.llm.decontaminate import decontaminate
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]
    extra = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "123 456", "en", "s", 7)], docs.schema)
    tables = [docs.union(extra)]
    for name, stage in C.STAGES:
        tables.append(written(stage(spark, tables[-1], sf), name))
        if name != "packing":
            assert tables[-1].schema.simpleString() == docs.schema.simpleString()
    raw, lang, lines, near, clean, packed = tables
    assert raw.count() - lang.count() == 2
    want = brute_lines([(r.doc_id, r.text) for r in lang.collect()])
    got = {r.doc_id: r for r in lines.collect()}
    assert {i: t for i, (n, d, t) in want.items() if len(d) < n or not n} == {i: r.text for i, r in got.items()}
    assert all(r.n_chars == len(r.text) for i, r in got.items() if want[i][1])
    ids = sorted(got)
    root, _ = brute_components([got[i].text for i in ids])
    assert {r.doc_id for r in near.collect()} == {ids[r] for r in root}
    bad = {r.doc_id for r in decontaminate(near, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert {r.doc_id for r in near.collect()} - bad == {r.doc_id for r in clean.collect()}
    pieces = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.expr("offset + length")).alias("end")).collect()
    assert all(p.n == p.end <= 2048 for p in pieces) and {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}
    assert np.unique([r.sequence_id for r in packed.collect()]).size == len(pieces)


def test_queries_registered():
    import __spark_entry__ as E
    names = list(E.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)


def test_language_stage_without_and_with_wrong_labels(spark, sf):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 !", None), (3, None, None), (4, "", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in C.language(spark, docs, sf).collect()] == [(1, "abc", None)]
    rows = [(i, "the cat sat on the mat and the dog ran off " * 5, "en") for i in range(20)]
    rows += [(100 + i, "это было давно и никто не помнит о том дне " * 5, "ru") for i in range(20)]
    rows += [(200, rows[0][1], "ru"), (201, rows[20][1], "en"), (202, rows[20][1], None)]
    got = {r.doc_id: r.lang for r in C.language(spark, spark.createDataFrame(rows, docs.schema), sf).collect()}
    assert got == {i: "en" if i < 100 or i == 200 else "ru" for i, _, _ in rows}


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(9)
    text = lambda: "\n".join(" ".join(rng.choice("abcdefgh") * 3 + str(rng.randint(0, 99)) for _ in range(12)) for _ in range(6))
    own = ["score", "lang_pred", "n_lines", "n_removed", "removed", "k_id", "k_mark", "k_text", "k_row", "k_words", "bad_id", "bad_hash", "others", "row", "id", "mark"]
    docs = spark.createDataFrame([(i, text(), "en", *[f"{c}{i}" for c in own]) for i in range(12)], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in own))
    once = docs.union(docs.where("doc_id < 4"))
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, once, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {r.doc_id for r in rows} == set(range(12)) and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in own), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").collect() == [], name


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_entries_are_exchanged_once_to_find_shared_shingles(spark):
    rows = [(t, n, 10) for n in range(40) for t in range(n, n + 6)] + [(1000 + n, n, 10) for n in range(40)] + [(5000, 3, 10), (5000, 3, 10)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = J._in_two(written(spark.createDataFrame(rows, "token long, node long, n long"), "entries"))
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(r for r in rows if 0 < r[0] < 44)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("Exchange hashpartitioning") == 2

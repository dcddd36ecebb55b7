"""Tokens, packing (1) and token files (2)."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import packing as P
from tabforge.llm import tokenfile as T
from tabforge.llm.tokens import default_tokenizer, encoder
from tabforge.session import work_path

TEXTS = [None, "", "A.", "don't <|endoftext|> o'll", "Été ½ ² ª naïve Σσς İ 漢字 é \x85 x", "word " * 5000, "word " * 5000]


def ids_of(text):
    t = encoder(default_tokenizer()).tokenizer
    return t.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "x") for i, t in zip(ids, texts)], "doc_id long, text string, length int, sequence_id string")


def test_encoder_matches_library():
    rng, e = random.Random(5), encoder(default_tokenizer())
    alphabet = "aB'sTéÉ 's'll 12 .,<|>\n\t́Σσİﬁ漢½²ªº×÷\x1c\x85\xa0\xad¡ÿß😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text, got in zip(texts, e.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text), repr(text)


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[i] <= capacity:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1:])
        go(i + 1, bins + [items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_plan_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(capacity // 4, capacity // 2) for _ in range(rng.randint(1, 10))]
        counts = {x: items.count(x) for x in items}
        plan = P.plan_bins(counts, capacity, 50_000)
        held = {}
        for pattern, n in plan:
            assert sum(x * k for x, k in pattern) <= capacity
            for x, k in pattern:
                held[x] = held.get(x, 0) + k * n
        assert held == counts
        assert P.lower_bound(counts, capacity) <= optimum(items, capacity) == sum(n for _, n in plan)


def test_plan_beats_best_fit():
    rng = random.Random(3)
    counts = {}
    for _ in range(5000):
        x = min(512, max(1, int(rng.lognormvariate(4.8, 1.0))))
        counts[x] = counts.get(x, 0) + 1
    found = sum(n for _, n in P.plan_bins(counts, 512))
    assert P.lower_bound(counts, 512) <= found <= sum(n for _, n in P.best_fit(counts, 512))
    assert P.plan_bins({}, 512) == []


def test_plan_searches_beyond_forced_bins():
    # more single bins than NODE_LIMIT come first; best-fit decreasing needs a bin more for the rest
    small = {6: 1, 5: 1, 4: 2, 3: 1, 2: 1}
    rest = {x * 80: n for x, n in small.items()}
    capacity = 960
    assert sum(n for _, n in P.best_fit(rest, capacity)) == 3 > P.lower_bound(rest, capacity)  == 2
    for n in (1, 5000, 5_000_000):
        plan = P.plan_bins(rest | {959: n, 957: n, 950: n}, capacity)
        assert sum(k for _, k in plan) == 3 * n + 2
        held = {}
        for pattern, k in plan:
            for x, c in pattern:
                held[x] = held.get(x, 0) + k * c
        assert held == rest | {959: n, 957: n, 950: n}


def test_fillings_are_all_there():
    counts = {x: 1 for x in range(100, 400)}          # more lengths than FILLING_LENGTHS
    got = list(P.fillings(counts, 450))
    assert len(got) == len(set(got))
    assert {f for f in got if sum(x * k for x, k in f) == 450} >= {((450 - x, 1), (x, 1)) for x in range(100, 225)}


def test_pack_round_trip(spark):
    docs = frame(spark, TEXTS + ["lorem ipsum " * k for k in range(1, 200)]).repartition(5)
    out = P.pack_documents(docs, capacity=256, with_ids=True)
    rows = out.collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 1024
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for r in docs.collect():
        parts = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.start for p in parts] == [256 * p.piece for p in parts]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == ids_of(r.text) + [0]
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert -(-total // 256) <= len(by_seq) <= -(-total // 256) + 2
    joined = {r.sequence_id: r for r in P.sequences(out).collect()}
    assert all(len(joined[s].ids) == 4 * sum(p.length for p in parts) for s, parts in by_seq.items())


def test_pack_edges(spark):
    docs = frame(spark, ["same"] * 3 + [None], [1, 1, None, 2])
    assert sorted((r.doc_id or -1, r.length) for r in P.pack_documents(docs).collect()) == [(-1, 2), (1, 2), (1, 2), (2, 1)]
    assert P.pack_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [False, True])
def test_payload_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 100, 1000):
        ids = rng.integers(0, 49_408 if n % 2 else 2**32, n, dtype=np.uint32).astype("<u4")
        raw = T.encode_payload(ids, block_ids=64, bits=bits)
        assert (T.decode_payload(raw, n) == ids).all()
        assert (T.decode_payload(raw, n, n // 3, n // 2) == ids[n // 3:n // 3 + n // 2]).all()
    with pytest.raises(ValueError):
        T.decode_payload(b"XXXX" + raw[4:], n)


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(spark, bits):
    docs = frame(spark, TEXTS + [f"doc {i} " * (i % 17) for i in range(300)]).repartition(4)
    path = work_path(spark, "tokens")
    T.write_token_files(docs, path, block_ids=128, segment_ids=500, bits=bits)
    got = {r.doc_id: r for r in T.read_token_files(spark, path, with_ids=True).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = ids_of(r.text) + [1]
        g = got[r.doc_id]
        assert np.frombuffer(g.ids, "<u4").tolist() == ids
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == docs.count()


def test_file_edges(spark):
    path = work_path(spark, "tokens")
    T.write_token_files(frame(spark, ["b", "a", "b", None], [1, 1, 1, None]), path)
    rows = T.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1] and [r.start for r in rows] == [0, 1, 3, 5]
    empty = work_path(spark, "tokens")
    T.write_token_files(frame(spark, ["x"]).where(F.lit(False)), empty)
    assert T.read_token_files(spark, empty).collect() == []

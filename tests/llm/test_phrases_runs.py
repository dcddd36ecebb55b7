"""Phrase collocations (12), periodic runs (13)."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tabforge.llm import collocations as P
from tabforge.llm import queries as Q
from tabforge.llm import runs as R

SCHEMA = "doc_id long, text string, lang string, phrase string, rank int"


def brute_phrases(rows, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        n[lang] += 0
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f[lang].update(tuple(w[i:i + s]) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    out = set()
    for lang, c in f.items():
        rows = []
        for g, a in c.items():
            if len(g) < 2 or a < 10:
                continue
            score, k = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(x) > len(g) and b >= 10 and 100 * b >= 50 * a and any(x[i:i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in c.items()):
                rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return out


def test_phrases_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_WORDS", 500)
    monkeypatch.setattr(P, "BUCKET_BYTES", 1500)
    rng = random.Random(3)
    vocab = ["a", "B", "b", "été", "İ", "x.y", "New", "york", "\x1cz", "K", "..", "q r"]
    rows = [(None, None), ("", "en"), (None, "en"), ("New York " * 30, "en"), ("a\tb\x0bc, " * 15, None), ("w" * 50000 + " end", "de")]
    for _ in range(150):
        text = "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t", "  ", "\n", ". ", "!"]) for _ in range(rng.randint(0, 40)))
        rows += [(text, rng.choice(["en", "en", "fr", None, "und"]))] * rng.choice([1, 1, 2])
    docs = spark.createDataFrame([(i, t, g, "p", 1) for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    for top in (2000, 3):
        got = [tuple(r) for r in P.collocations(docs, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, top)
    assert P.collocations(docs.limit(0)).collect() == []


def test_merged_summaries_keep_every_frequent_gram(monkeypatch):
    rng = np.random.default_rng(5)
    for turn in range(30):
        monkeypatch.setattr(P, "MERGED", [1, 1000, 10 ** 6][turn % 3])
        blocks = [np.unique((rng.zipf(1.3, 400) % 700).astype(np.uint64), return_counts=True) for _ in range(20)]
        exact = Counter()
        for k, c in blocks:
            exact.update(dict(zip(k.tolist(), c.tolist())))
        for threshold in (3, 10, 100):
            capacity = sum(exact.values()) // threshold + 1
            keys, counts, taken = P.merge_summaries(iter(blocks), capacity)
            assert len(keys) <= capacity and {k for k, c in exact.items() if c >= threshold} <= set(keys.tolist())
            assert taken < threshold and all(c <= exact[k] <= c + taken for k, c in zip(keys.tolist(), counts.tolist()))


def test_bit_table_holds_all_survivors(spark):
    docs = spark.createDataFrame([("one two three " * 20, "en"), ("four five " * 13, "en")], "text string, lang string")
    kept = P.summaries(docs, 7)
    table, lead = P.bit_table(kept)
    keys = np.concatenate([np.frombuffer(r["keys"], "<u8") for r in kept.collect()])
    at = (keys >> np.uint64(64 - lead)).astype(np.int64)
    assert len(keys) >= 9 and ((table[at >> 3] >> (7 - (at & 7))) & 1).all()


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(w[t] == w[t + d] for t in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_texts(rng, count):
    for _ in range(count):
        w, most = [], rng.randint(0, 120)
        while len(w) < most:
            if rng.random() < 0.4:
                w += [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 10))]
            else:
                unit = [rng.choice(["a", "b", "é", "d"][:rng.randint(1, 4)]) for _ in range(rng.randint(1, 14))]
                w += (unit * rng.randint(2, 7))[:rng.randint(1, 80)]
        yield w


def test_runs_match_brute_force():
    for w in periodic_texts(random.Random(2), 1500):
        assert R.periodic_runs(R.word_numbers([x.encode() for x in w])) == brute_runs(w), w


def test_runs_of_long_texts():
    assert R.periodic_runs(np.zeros(300000, np.int64)) == [(0, 300000, 1)]
    unit = np.random.default_rng(1).integers(0, 50, 7000)
    assert R.periodic_runs(np.concatenate([[99], np.tile(unit, 5), [99]])) == [(1, 35000, 7000)]


def test_run_query(spark):
    rng = random.Random(8)
    texts = [None, "", "one", " \t\n", "a " * 200, "  x\x1cy"] + [rng.choice([" ", "\n"]).join(w) for w in periodic_texts(rng, 300)]
    rows = [(i - 3, t, "r", 0) for i, t in enumerate(texts)] + [(None, "b " * 9, "r", 0), (5, "c c c", "r", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int").repartition(3)
    got = sorted(map(tuple, R.run_digests(R.find_runs(docs, Q.echo_tail)).collect()), key=str)
    want = []
    for i, t, _, _ in rows:
        w = Q.echo_tail(i, [x for x in re.split(rb"[\x20\x09-\x0D]+", (t or "").encode()) if x])
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    assert got == sorted(want, key=str)
    assert R.run_digests(R.find_runs(docs.limit(0))).collect() == []


def test_echo_tail_of_the_contract():
    import zlib
    for i in range(400):
        words = [b"w%d" % k for k in range(i)]
        h = zlib.crc32(b"%d" % i)
        if h % 10 == 0 and i:
            a, g = (h // 10) % i, h // 10
            p = 1 + (i - a) // (3 + g % 8)
            assert R.word_numbers(Q.echo_tail(i, words)).tolist() == R.word_numbers([words[k] if k < a else words[a + (k - a) % p] for k in range(i)]).tolist()
        else:
            assert Q.echo_tail(i, words) == words

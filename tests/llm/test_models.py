"""Importance resampling (3), robust outliers (4), language ID (9)."""

import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tabforge.llm import langid as L
from tabforge.llm import outliers as O
from tabforge.llm import resampling as R


def test_kth_greatest(spark, monkeypatch):
    monkeypatch.setattr(R, "BRACKET", 10)
    rng = random.Random(1)
    rows = [(rng.choice([0.0, 1.5, rng.gauss(0, 100)]), i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "key double, id long, mark long")
    line = sorted(rows, reverse=True)
    for k in (1, 7, 250, 500, 900):
        got = R.kth_greatest(df, k)
        assert got[0] == line[min(k, 500) - 1][0] and (got[1] is None or got[:2] == line[min(k, 500) - 1][:2])
    assert R.kth_greatest(df, 0) is None


def test_weights_match_brute_force(spark):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    texts = [" ".join(rng.choice(good if i % 3 else bad) for _ in range(rng.randint(1, 60))) for i in range(150)] + ["", None, "same text", "same text"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, kept int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 10 == 1)) for i in range(100)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in R.importance_sample(docs, labels).collect()}
    target, raw = collections.Counter(), collections.Counter()
    for i, t in enumerate(texts):
        raw.update(R.gram_buckets(t).tolist())
        if i < 100 and i % 3 and i % 10 != 1:
            target.update(R.gram_buckets(t).tolist())
    share = sum(target.values()) / sum(raw.values())
    for i, t in enumerate(texts):
        want = sum(math.log((target[b] + R.PRIOR) / (raw[b] * share + R.PRIOR)) for b in R.gram_buckets(t).tolist())
        assert abs(got[i].log_weight - want) < 1e-5 and got[i].n_grams == len(R.gram_buckets(t))
    n_target = sum(i % 3 > 0 and i % 10 != 1 for i in range(100))
    k = round(len(texts) * n_target / 100)
    line = sorted(got.values(), key=lambda r: -r.sample_key)
    assert [r.kept for r in line] == [True] * k + [False] * (len(texts) - k)
    assert len(R.gram_buckets("a b c")) == 5 and len(R.gram_buckets(None)) == 0


def test_sample_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.log_weight == 0 for r in R.importance_sample(docs, none).collect())
    assert not any(r.kept for r in R.importance_sample(docs, none, k=0).collect())
    assert R.importance_sample(docs.limit(0), none).collect() == []


def brute_counts(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in O.SPACES:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    lines = [x for x in text.split("\n") if any(c not in O.SPACES for c in x)]
    grams = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), sum(c.isupper() for c in text))


def test_counts_match_brute_force():
    rng = random.Random(3)
    for t in [None, "", " \n\t ", "a" * 10000, "x y " * 3000, "é\x85b\xa0c d\x1ce", "1\n1\n\n \n1"]:
        assert O.text_counts(t) == brute_counts(t)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "\n", "É", "#", "a b c d e "]) for _ in range(rng.randint(0, 40)))
        assert O.text_counts(t) == brute_counts(t), repr(t)


def test_chi2():
    assert abs(O.chi2_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(O.chi2_quantile(0.975, 2) - 7.3778) < 1e-3


def mcd_by_numpy(x):
    """The same estimate in plain numpy, from medians and from means."""
    p, n = x.shape[1], len(x)
    h, floor = math.ceil(n * O.SHARE), np.diag(O.FLOOR ** 2)

    def steps(mu, cov):
        for _ in range(60):
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            bins = np.floor(np.log2(np.maximum(d, 0) + 1e-6) * 64)
            near = x[bins <= np.sort(bins)[h - 1]]
            mu, cov = near.mean(0), np.cov(near.T, bias=True) * O.consistency(O.SHARE, p) + floor
        return np.linalg.slogdet(cov)[1], mu, cov

    mid = np.median(x, 0)
    starts = [(mid, np.diag((1.4826 * np.median(abs(x - mid), 0)) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)]
    _, mu, cov = min((steps(*s) for s in starts), key=lambda s: s[0])
    d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
    near = x[d <= O.chi2_quantile(O.REWEIGHT, p)]
    return near.mean(0), np.cov(near.T, bias=True) * O.consistency(O.REWEIGHT, p) + floor


def test_mcd_withstands_outliers(spark):
    rng = np.random.default_rng(5)
    k = len(O.X)
    data = {"a": np.vstack([rng.normal(0, 1, (300, k)), rng.normal(12, 0.5, (90, k))]), "b": rng.normal(3, 2, (200, k))}
    rows = [(g, *map(float, r)) for g, x in data.items() for r in x]
    got = {r.g: r for r in O.fit(spark.createDataFrame(rows, ["g", *O.X]).repartition(5)).collect()}
    for g, x in data.items():
        mu, cov = mcd_by_numpy(x)
        assert np.allclose(got[g].mu, mu, atol=0.05)
        assert np.allclose(np.linalg.inv(np.array(got[g].inv).reshape(k, k)), cov, atol=0.15 * cov.max())
    assert max(abs(np.array(got["a"].mu))) < 0.4        # the 90 far rows don't move it


def test_judge_quality(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    clean = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 300)))
    rows = [(i, clean(), "en", "s0") for i in range(200)] + [(200 + i, clean(), "fr", f"t{i % 3}") for i in range(90)]
    rows += [(300 + i, " ".join(w + "###" for w in clean().split()), "en", "s0") for i in range(20)]
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, "few words", "en", "s0"), (403, "rep rep rep rep " * 9, "en", "s0")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, mu int")
    got = {r.doc_id: r for r in O.judge_quality(docs.repartition(4)).collect()}
    again = {r.doc_id: r for r in O.judge_quality(docs.repartition(2)).collect()}
    assert {k: v.kept for k, v in got.items()} == {k: v.kept for k, v in again.items()}
    for i, t, _, _ in rows:
        n = brute_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_upper) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    assert sum(got[i].kept for i in range(290)) >= 285
    assert not any(got[i].kept for i in [*range(300, 320), 400, 401, 402, 403])


def test_judge_moderate_outliers(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    clean = lambda n=0: [rng.choice(vocab) for _ in range(n or rng.randint(30, 300))]
    rows = [(i, " ".join(clean()), "en") for i in range(300)]
    rows += [(400 + i, " ".join(w + "#" * (j % 20 in (3, 9, 15)) for j, w in enumerate(clean(100))), "en") for i in range(10)]     # 15 symbols
    rows += [(500 + i, " ".join(w + w[:1] * round(len(w) * 1.3) for w in clean(100)), "en") for i in range(10)]                    # 2.3 times as long
    rows += [(600 + i, "".join(c.upper() if j % 14 == 0 and c != " " else c for j, c in enumerate(" ".join(clean(200)))), "en") for i in range(10)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in O.judge_quality(docs).collect()}
    assert sum(got[i].kept for i in range(300)) >= 297
    assert not any(got[i].kept or got[i].base_failed for i in got if i >= 400)
    assert max(got[i].distance for i in range(400, 410)) < 38       # below the quantile of 1 - 1e-6


def test_floor_is_a_limit():
    wide, none = np.diag((2 * O.FLOOR) ** 2), np.zeros((len(O.X), len(O.X)))
    assert np.allclose(O.floor_as_limit(wide), wide) and np.allclose(O.floor_as_limit(none), np.diag(O.FLOOR ** 2))


def test_judge_edges(spark):
    docs = spark.createDataFrame([(None, "one two three four five six seven eight nine ten", None, None)] * 2, "doc_id long, text string, lang string, source string")
    assert [(r.kept, r.distance) for r in O.judge_quality(docs).collect()] == [(True, None)] * 2
    assert O.judge_quality(docs.limit(0)).collect() == []


def plain_bits(train, text, order):
    """PPM code length, byte by byte, from dictionaries."""
    count = collections.defaultdict(collections.Counter)
    for t in train:
        for i in range(len(t)):
            for k in range(min(i, order) + 1):
                count[t[i - k:i]][t[i]] += 1
    total = 0.0
    for i, b in enumerate(text):
        for k in range(min(i, order), -2, -1):
            if k < 0:
                total += 8
                break
            seen = count.get(text[i - k:i])
            if seen:
                n, q = sum(seen.values()), len(seen)
                if b in seen:
                    total -= math.log2(seen[b] / (n + q))
                    break
                total -= math.log2(q / (n + q))
    return total


def test_ppm_matches_brute_force(spark):
    rng = random.Random(6)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    train = [(i, make("abc ", rng.randint(1, 60)), "x") for i in range(20)] + [(50 + i, make("bcdé ", rng.randint(1, 60)), "y") for i in range(20)]
    docs = spark.createDataFrame([*train, (90, None, "x"), (91, "abc", None)], "doc_id long, text string, lang string").repartition(3)
    model = L.train(docs)
    for text in ["a", "ab", "abcabc", "dé dé", "zzz", make("abcdé z", 200), "é"]:
        data = text.encode()
        want = [plain_bits([t.encode() for _, t, lang in train if lang == name], data, L.ORDER) for name in ("x", "y")]
        assert np.allclose(model.text_bits(np.frombuffer(data, np.uint8)), want)
    texts = [np.frombuffer(make("abcd ", n).encode(), np.uint8) for n in (1, 2, 3, 4, 5, 50, 300)]
    assert np.allclose(model.batch_bits(texts), [model.text_bits(t) for t in texts])


def test_language_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", L.held_out(F.col("doc_id")))
    got = L.identify(docs, L.train(docs.where(~F.col("held")))).where("held").selectExpr("avg(int(lang = lang_pred)) a", "min(score) s").first()
    assert got.a > 0.97 and 0 <= got.s <= 1


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 1.0), (2, "", "x", 1.0), (3, "12 !", "x", 1.0), (None, "abc", None, 1.0), (4, "abc", "x", 1.0), (4, "abc" * 500_000, "x", 1.0)],
                                 "doc_id long, text string, lang string, score double")
    got = L.identify(docs, L.train(docs)).collect()
    assert sorted(r.lang_pred for r in got) == ["und"] * 3 + ["x"] * 3 and {r.score for r in got} == {0.0, 1.0}
    assert {r.lang_pred for r in L.identify(docs, L.train(docs.where("lang IS NULL"))).collect()} == {"und"}
    assert L.identify(docs.limit(0), None).collect() == []


def test_language_learns_every_label(spark, monkeypatch):
    rng = random.Random(8)
    names = [f"l{i:02}" for i in range(70)]
    word = lambda i: "".join(chr(0x4E00 + 40 * i + rng.randrange(40)) for _ in range(4))
    # the rarer a language, the later its name; the last has a single document
    rows = [(100 * i + j, " ".join(word(i) for _ in range(6)), names[i]) for i in range(70) for j in range(1 + (69 - i) // 20)]
    docs = spark.createDataFrame([*rows, (9000, rows[-1][1], None), (9001, None, None), (9002, "12 !", names[0])], "doc_id long, text string, lang string").repartition(4)
    whole = L.train(docs)
    assert isinstance(whole, L.Model) and whole.languages == names
    one = {r.doc_id: r for r in L.identify(docs, whole).collect()}
    assert all(one[i].lang_pred == name for i, _, name in rows) and one[9000].lang_pred == names[-1]
    monkeypatch.setattr(L, "MODEL_CELLS", 50_000)
    cut = L.train(docs)
    assert len(cut) > 2 and [x for b in cut for x in b.value.languages] == names
    many = {r.doc_id: r for r in L.identify(docs, cut).collect()}
    assert set(many) == set(one) and {i: r.lang_pred for i, r in many.items()} == {i: r.lang_pred for i, r in one.items()}
    assert all(abs(many[i].score - one[i].score) < 1e-6 and many[i].text == one[i].text for i in one)
    assert many[9001].lang_pred == many[9002].lang_pred == "und"

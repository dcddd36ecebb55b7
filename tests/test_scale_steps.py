"""Steps that must not grow faster than the rows: what a pass evaluates, keeps and shares."""

from pyspark.sql import functions as F

from tabforge.functions.exprs import trim_all
from tabforge.operators import fitted, models, stats
from tabforge.sources import tables


def _rows(spark, n=400):
    i = F.col("id")
    return spark.range(0, n, 1, 2).select(i.alias("k"), (i % 7).cast("double").alias("a"), ((i * 13) % 50).cast("double").alias("b"),
                                          F.sqrt(i).alias("c"), (i % 3).cast("double").alias("d"), F.sin(i).alias("e"), F.cos(i).alias("f"),
                                          ((i * 13) % 50 > 25).cast("int").alias("y"))


def test_moments_in_small_jobs(spark, monkeypatch):
    df, sizes = _rows(spark), []
    monkeypatch.setattr(type(df), "agg", lambda self, *e: sizes.append(len(e)) or self.groupBy().agg(*e))
    got = stats.corr_pairs(df, list("abcdef"))
    assert len(got) == 15 and max(sizes) <= 16


def test_search_keeps_what_fits_read(spark, monkeypatch):
    seen = []

    class Search(models.CrossValidator):
        def fit(self, dataset):
            seen.append((dataset.columns, self.getParallelism()))
            return super().fit(dataset)

    monkeypatch.setattr(models, "CrossValidator", Search)
    monkeypatch.setattr(models, "PARALLEL_FIT_ROWS", 10)
    df = _rows(spark)
    best = models.tune(df, "y", "random_forest", {"n_estimators": [2], "max_depth": [2, 3]}, fixed={"random_state": 1}, keys=["k"], folds=2)
    assert seen == [(["features", "label", "__fold"], 1)]
    assert best.metrics["validation_f1_weighted"] > 0.9
    assert best.model.transform(df.withColumn("label", F.col("y").cast("double"))).count() == 400


def test_leak_free_fits_on_kept_rows(spark, monkeypatch):
    plans, fit = [], fitted.fit

    def spy(df, *args, **options):
        plans.append(df._jdf.queryExecution().withCachedData().toString())
        return fit(df, *args, **options)

    monkeypatch.setattr(fitted, "fit", spy)
    train, test, _ = fitted.leak_free(_rows(spark), "y", ["k"], correlation="skip")
    assert "InMemoryRelation" in plans[0]
    assert "InMemoryRelation" not in test._jdf.queryExecution().withCachedData().toString()
    assert train.count() + test.count() == 400


def test_csv_types_from_one_row_per_value(spark, tmp_path, monkeypatch):
    (tmp_path / "t.csv").write_text('whole,number,flag,mixed,text,none\n 1 ,1.5,True,1,a,\n+2,7,false,x,b,NA\n,inf,,,,\n', encoding="utf-8")
    raw = spark.range(1)
    calls, unpivot = [], type(raw).unpivot
    monkeypatch.setattr(type(raw), "unpivot", lambda self, *a: calls.append(1) or unpivot(self, *a))
    df = tables.load_table(spark, str(tmp_path / "t.csv"))
    assert calls == [1]
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    assert [tuple(r)[:3] for r in df.collect()] == [(1, 1.5, True), (2, 7.0, False), (None, float("inf"), None)]


def test_trim_is_the_pattern(spark):
    texts = ["", " ", "a", " a b\t", "\n\x0b\f\ra\r\n", "a \u2028", "\u2028 a \x85", " \u2029", "a\u00a0 ", "a \u2028b ", "a \u2028\u2028", "a \n\x85"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select(trim_all(F.col("v")).alias("new"), F.regexp_replace("v", r"^\s+|\s+$", "").alias("old"))
    assert [r.new for r in rows.collect()] == [r.old for r in rows.collect()]

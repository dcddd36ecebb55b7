"""Observed writes, fitted preparation, candidates, validation, reports, wide categories."""

import json

import pytest
from pyspark.sql import functions as F

from tabforge import fixtures as fx
from tabforge.errors import DataError, ParamError
from tabforge.fixtures import LINEITEM_KEYS as LK
from tabforge.operators import candidates as C
from tabforge.operators import fitted, gate, metrics, models, wide_encode
from tabforge.plans import validate
from tabforge.plans.stages import predictions, promote, score_promoted, split_stage
from tabforge.sources import reports
from tabforge.sources.runlog import RunLog
from tabforge.sources.tables import continuity_check, logged_write, write_schema, write_stage


def test_write_computes_a_table_once(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = spark.range(1000).repartition(3).mapInArrow(seen, "id long")
    assert write_stage(df, str(tmp_path / "a")) == 1000 and rows.value == 1000
    with pytest.raises(DataError):
        write_stage(df, str(tmp_path / "b"), rows=999)
    assert write_stage(df.limit(0), str(tmp_path / "c")) == 0


def test_continuity_looks_at_the_last_counted_step(spark, tmp_path):
    log, path = RunLog("prep"), str(tmp_path / "t")
    log.step("impute_missing", {}, 9, 9)
    logged_write(spark.range(7), path, log, "impute_missing", {}, 9)
    log.step("impute_missing", {}, 7, None)
    steps = log.steps_frame(spark)
    ok = lambda tools: continuity_check(spark, path, steps, tools).first()
    assert (ok(["impute_missing"]).n, ok(["impute_missing"]).ok) == (7, True)
    log.step("drop_columns", {}, 7, 8)
    steps = log.steps_frame(spark)
    assert not ok(["impute_missing", "drop_columns"]).ok and ok(["encode_features"]).ok


def test_prepare_writes_and_checks_its_tables(spark, sf, tmp_path):
    from tabforge.plans.prep import prepare
    res = prepare(fx.fx_full(spark, sf), "is_big", keys=LK, manual_drops=["user_id"], folder=str(tmp_path))
    plain = prepare(fx.fx_full(spark, sf), "is_big", keys=LK, manual_drops=["user_id"], count_steps=True)
    assert res.features == plain.features and sorted(map(tuple, res.table.collect())) == sorted(map(tuple, plain.table.collect()))
    rows = {s[2]: s[5] for s in plain.log.steps}
    logged = {s[2]: s[5] for s in res.log.steps if s[5] is not None}
    assert logged == {"impute_missing": rows["impute_missing"], "filter_by_correlation": rows["filter_by_correlation"], "finalize_preparation": res.table.count()}
    steps = res.log.steps_frame(spark)
    assert validate.prep_checks(spark, f"{tmp_path}/cleaned", f"{tmp_path}/schema", "is_big", LK).where("NOT ok").isEmpty()
    res.table.limit(3).write.mode("append").parquet(f"{tmp_path}/cleaned")
    assert not continuity_check(spark, f"{tmp_path}/cleaned", steps, ["finalize_preparation"]).first().ok


def test_fitted_preparation(spark, sf, tmp_path):
    raw = fx.fx_full(spark, sf)
    train, test, prep = fitted.leak_free(raw, "is_big", LK, manual_drops=["user_id"], outlier="iqr_cap", balance="undersample")
    counts = [r["count"] for r in train.groupBy("is_big").count().collect()]
    assert train.columns == test.columns == [*LK, *prep.features, "is_big"]
    assert "k" not in prep.features and "user_id" in prep.dropped and len(counts) == 2
    prep.save(spark, str(tmp_path / "prep"))
    again = fitted.FittedPrep.load(spark, str(tmp_path / "prep"))
    assert again == prep
    new = raw.drop("is_big").limit(50)
    scored = again.apply(new, keep_outliers=True)
    assert scored.count() == 50 and scored.columns == [*LK, *prep.features]
    assert scored.where(F.greatest(*[F.col(f"`{c}`").isNull().cast("int") for c in [*prep.features, LK[0]]]) > 0).isEmpty()
    assert set(prep.fill_values()) >= {"l_quantity", "l_extendedprice"}
    with pytest.raises(DataError):
        prep.apply(new.drop("l_extendedprice"))
    with pytest.raises(ParamError):
        fitted.fit(raw, "is_big", LK, imputation="knn")
    with pytest.raises(DataError):
        fitted.FittedPrep.from_json(json.dumps({"target": "t"}))


def test_fitted_values_do_not_follow_the_other_table(spark):
    rows = [(i, float(i % 10), "ab"[i % 2], i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "id int, x double, c string, t int")
    prep = fitted.fit(train, "t", ["id"], outlier="iqr_remove", correlation="skip")
    other = spark.createDataFrame([(1, None, "zz", 0), (2, 1e9, None, 1), (3, 2.0, " B ", None)], "id int, x double, c string, t int")
    assert [tuple(r) for r in prep.apply(other).collect()] == [(1, 4.5, 0, 0)]
    assert [tuple(r) for r in prep.apply(other.drop("t"), keep_outliers=True).orderBy("id").collect()] == [(1, 4.5, 0), (2, 1e9, 0), (3, 2.0, 1)]


@pytest.mark.parametrize("given, reference, highest", [
    ([("baseline", 0.5), ("baseline", 0.9)], 1, 2),
    ([("baseline", 0.5), ("grid_search", 0.5), ("grid_search", 0.4)], 2, 1),
    ([("grid_search", 0.6), ("baseline", 0.9), ("grid_search", 0.7), ("grid_search", 0.7)], 4, 2),
    ([("baseline", None), ("grid_search", None)], 2, 1),
    ([("grid_search", 0.9), ("grid_search", 0.2)], 1, 1),
])
def test_candidate_seat(spark, tmp_path, given, reference, highest):
    folder = str(tmp_path / "candidates")
    registry = models.CandidateRegistry()
    for i, (method, f1) in enumerate(given, 1):
        m = {"validation_f1_weighted": f1}
        assert C.append_candidate(spark, folder, "rule", method, {"i": i}, m) == f"candidate_{i}"
        registry.add(models.Candidate(f"candidate_{i}", "rule", method, {}, m, None, [], [], "t"))
    table = C.read_candidates(spark, folder)
    assert C.promote_row(table)["seq"] == reference and registry.best().id == f"candidate_{reference}"
    assert C.promote_row(table, "max_val_f1")["seq"] == highest
    assert C.promote_row(table, explicit="candidate_2")["seq"] == 2
    with pytest.raises(ParamError):
        C.promote_row(table, explicit="candidate_9")


def test_candidate_limits(spark, tmp_path):
    folder = str(tmp_path / "candidates")
    with pytest.raises(DataError):
        C.promote_row(C.read_candidates(spark, folder))
    for _ in range(2):
        C.append_candidate(spark, folder, "rule", "baseline", {}, {}, cap=2)
    with pytest.raises(ParamError):
        C.next_candidate(spark, folder, cap=2)
    with pytest.raises(ParamError):
        C.seat(C.read_candidates(spark, folder), "newest")


def test_remediation_steps():
    assert len(gate.remediation_steps("  ")) == len(gate.remediation_steps(None)) == 4
    assert gate.remediation_steps('["a", " b "]') == gate.remediation_steps("a\n\n b") == gate.remediation_steps(["a", "", "b "]) == ["a", "b"]
    assert gate.remediation_steps("{not json") == ["{not json"]
    with pytest.raises(ParamError):
        gate.failure_record(None, "a rationale of enough characters", [" "])


def test_good_outputs_pass_all_checks(spark, sf, tmp_path):
    table, folder = fx.fx_high(spark, sf).drop("l_returnflag"), str(tmp_path)
    sides = split_stage(table, "is_high", keys=LK)
    write_stage(table, f"{folder}/cleaned")
    schema = [{"name": c, "type": "numeric", "categories": None, "drop_first": None, "dummy_columns": None} for c in table.columns if c not in (*LK, "is_high")]
    write_schema(spark, schema, f"{folder}/schema")
    for name, side in (("train", sides.train), ("test", sides.test)):
        write_stage(side, f"{folder}/split/{name}")
    best = models.train_baseline(sides.train, "is_high", "logistic_regression", {"C": 1.0, "max_iter": 20}, keys=LK)
    promote(best, f"{folder}/bundle", schema)
    C.append_candidate(spark, f"{folder}/candidates", best.algorithm, "baseline", best.params, best.metrics, f"{folder}/bundle")
    log = RunLog("train")
    log.decision("algorithm", ["a", "b"], "a", "Small table, so the simplest model is tried first.")
    both = {n: metrics.weighted_metrics(predictions(best, s), "actual", "predicted", best.classes) for n, s in (("train", sides.train), ("test", sides.test))}
    verdict = gate.record_verdict(gate.deploy_signals(both["train"], both["test"], sides.test, "is_high"), "deploy", "Both F1 values are far above the limits.")
    values = both["test"].first().asDict()
    models.add_evaluation(spark, f"{folder}/bundle", {"f1_weighted": 0.0}, "DO NOT DEPLOY", "an earlier one")
    models.add_evaluation(spark, f"{folder}/bundle", values, "DEPLOY", "Both F1 values are far above the limits.")
    found = models.load_bundle(spark, f"{folder}/bundle")["evaluation_metrics"]
    assert found["verdict"] == "DEPLOY" and found["f1_weighted"] == pytest.approx(values["f1_weighted"])
    scored = score_promoted(table.drop("is_high"), f"{folder}/bundle")
    measured = both["train"].withColumn("split", F.lit("train")).unionByName(both["test"].withColumn("split", F.lit("test")))
    parts = [validate.prep_checks(spark, f"{folder}/cleaned", f"{folder}/schema", "is_high", LK), validate.split_checks(spark, f"{folder}/split", "is_high", LK),
             validate.train_checks(spark, f"{folder}/bundle", "is_high", C.read_candidates(spark, f"{folder}/candidates"), log.decisions_frame(spark)),
             validate.evaluation_checks(measured, verdict), validate.deploy_checks(verdict, scored)]
    rows = [r for p in parts for r in p.collect()]
    assert len(rows) > 30 and [r for r in rows if not r.ok] == []
    gone = validate.table_checks(spark, "split", f"{folder}/nowhere", "is_high", name="train").collect()
    assert [(r.check, r.ok) for r in gone] == [("exists", False)]
    report = reports.run_report(log.steps_frame(spark), log.decisions_frame(spark), verdict=verdict).orderBy("position").collect()
    assert [r.section for r in report] == ["decisions"] + ["verdict"] * 6


def test_train_and_evaluate_leave_tables(spark, sf, tmp_path):
    from tabforge.plans.stages import evaluate_stage, train_stage
    table = fx.fx_high(spark, sf).drop("l_returnflag")
    sides = split_stage(table, "is_high", keys=LK, folder=str(tmp_path / "split"))
    assert sides.train.count() + sides.test.count() == table.count() and sides.log.steps[-1][2] == "finalize_split"
    done = train_stage(sides.train, "is_high", keys=LK, baseline=("logistic_regression", {"C": 1.0, "max_iter": 10}), search=None, folder=str(tmp_path))
    rows = C.read_candidates(spark, str(tmp_path / "candidates")).collect()
    assert [(r.candidate_id, r.method) for r in rows] == [("candidate_1", "baseline")] and done.best.extra["row"] == "candidate_1"
    promote(done.best, str(tmp_path / "bundle"), [])
    found = evaluate_stage(done.best, sides.train, sides.test, bundle=str(tmp_path / "bundle"))
    kept = models.load_bundle(spark, str(tmp_path / "bundle"))["evaluation_metrics"]
    assert kept["verdict"] == found.verdict.first().verdict and kept["auc"] == pytest.approx(found.auc)
    for _ in range(4):
        C.append_candidate(spark, str(tmp_path / "candidates"), "rule", "baseline", {}, {})
    with pytest.raises(ParamError):
        train_stage(sides.train, "is_high", keys=LK, search=None, folder=str(tmp_path))


def test_wide_categories(spark):
    df = spark.createDataFrame([(1, "b", "y"), (2, "a", None), (3, None, "x"), (4, "c", "x"), (5, "a", "y")], "id int, p string, q string")
    index = wide_encode.category_index(df, ["q", "p"], "one_hot_drop_first")
    assert sorted((r.position if r.position is not None else -1, r.column_name, r.category) for r in index.collect()) == [
        (-1, "q", "x"), (0, "q", "y"), (1, "p", "a"), (2, "p", "b"), (3, "p", "c")]
    rows = wide_encode.sparse_dummies(df.union(spark.createDataFrame([(6, "new", "y")], df.schema)), index, ["q", "p"], ["id"])
    assert {r.id: (r["size"], r.positions) for r in rows.collect()} == {1: (4, [0, 2]), 2: (4, [1]), 3: (4, []), 4: (4, [3]), 5: (4, [0, 1]), 6: (4, [0])}
    many = spark.range(5000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("p"))
    numbered = [r.category for r in wide_encode.category_index(many, ["p"]).orderBy("position").collect()]
    assert numbered == sorted(numbered) and len(numbered) == 5000
    with pytest.raises(ParamError):
        wide_encode.category_index(df, ["p"], "hash")

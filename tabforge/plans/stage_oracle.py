"""DuckDB SQL of ``stage_queries``."""

from __future__ import annotations

from tabforge.plans.oracle import _LK, _SIG, K, _fences, _strat_alloc, clean, md5_key, with_fx
from tabforge.plans.stage_queries import RULES

_SIZE = "(SELECT CASE WHEN count(*) < 5000 THEN 0.2 WHEN count(*) < 20000 THEN 0.25 ELSE 0.3 END FROM fx)"

ROW_CONTINUITY = with_fx("fx_high", """
SELECT 'written' AS state, 'row_count' AS "check", 'impute_missing' AS column_name, count(*) AS n, true AS ok FROM fx
UNION ALL SELECT 'rows repeated', 'row_count', 'impute_missing', count(*) + 5, false FROM fx""")

SPLIT_WRITTEN = with_fx("fx_high", """
SELECT r.is_high, count(*) AS n, CASE WHEN rk < alloc.n_cut THEN 'train' ELSE 'test' END AS side
FROM r JOIN alloc ON CAST(r.is_high AS VARCHAR) = alloc.cls GROUP BY 1, 3""", _strat_alloc(_SIZE))

# ---- fit on the training side, apply to the test side
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "k"]
_ALL = "fx AS (SELECT * REPLACE (lower(l_returnflag) AS l_returnflag) FROM raw WHERE is_big IS NOT NULL)"


def _outside(source: str) -> str:
    return " OR ".join(f"(f.column_name = '{c}' AND ({source}.{c} < q1 - 3 * (q3 - q1) OR {source}.{c} > q3 + 3 * (q3 - q1)))" for c in _NUM)


def _with_full(parts: str, body: str) -> str:
    return with_fx("fx_full", "").replace("WITH fx AS", "WITH raw AS", 1).strip() + f", {parts} {body}"


_FITTED = f"""{_ALL},
c AS (SELECT is_big AS cls, count(*) AS n FROM fx GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(n) - ceil(0.2 * sum(n)) AS n_train FROM c),
a AS (SELECT cls, n / total * n_train AS cont FROM c, t),
fl AS (SELECT cls, floor(cont) AS base, cont - floor(cont) AS rem FROM a),
alloc AS (SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= (SELECT n_train FROM t) - (SELECT sum(base) FROM fl) THEN 1 ELSE 0 END AS n_cut FROM fl),
r AS (SELECT *, row_number() OVER (PARTITION BY is_big ORDER BY {md5_key(_LK)}) - 1 AS rk FROM fx),
train AS (SELECT r.* FROM r JOIN alloc ON r.is_big = alloc.cls WHERE rk < n_cut),
test AS (SELECT r.* FROM r JOIN alloc ON r.is_big = alloc.cls WHERE rk >= n_cut),
f AS ({_fences(_NUM, "train")}),
clean AS (SELECT * FROM train WHERE NOT EXISTS (SELECT 1 FROM f WHERE q3 - q1 > 0 AND ({_outside("train")}))),
m AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _NUM)},
             (SELECT l_returnflag FROM clean WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS l_returnflag FROM clean),
filled AS (SELECT {", ".join(f"coalesce(clean.{c}, m.{c}) AS {c}" for c in [*_NUM, "l_returnflag"])} FROM clean, m),
s AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUM[:-1])},
             {", ".join(f"avg(CAST(l_returnflag = '{v}' AS INTEGER)) AS m_{v}, stddev_pop(CAST(l_returnflag = '{v}' AS INTEGER)) AS s_{v}" for v in "anr")} FROM filled)"""

FITTED_APPLY = _with_full(_FITTED, f"""
SELECT {K}, {", ".join(f"round((coalesce(test.{c}, m.{c}) - m_{c}) / s_{c}, 6) AS {c}" for c in _NUM[:-1])}, coalesce(test.k, m.k) AS k,
       {", ".join(f"round((CAST(coalesce(test.l_returnflag, m.l_returnflag) = '{v}' AS INTEGER) - m_{v}) / s_{v}, 6) AS l_returnflag_{v}" for v in "anr")}, is_big
FROM test, m, s""")

# ---- a preparation with something to do at every step
_PREPARED = f"""f AS ({_fences(_NUM, "raw")}),
kept AS (SELECT * FROM raw WHERE NOT EXISTS (SELECT 1 FROM f WHERE q3 - q1 > 0 AND ({_outside("raw")}))),
m AS (SELECT {", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in _NUM[:-1])},
             (SELECT lower(l_returnflag) FROM kept WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS l_returnflag FROM kept),
done AS (SELECT is_big, {", ".join(f"coalesce(kept.{c}, m.{c}) AS {c}" for c in _NUM[:-1])}, kept.k,
                {", ".join(f"CAST(coalesce(lower(kept.l_returnflag), m.l_returnflag) = '{v}' AS INTEGER) AS l_returnflag_{v}" for v in "anr")} FROM kept, m WHERE is_big IS NOT NULL),
w AS (SELECT name, pos, CASE WHEN isnan(v) OR v IS NULL THEN 0 ELSE abs(v) END AS v FROM (
      SELECT unnest({[*_NUM, *[f"l_returnflag_{v}" for v in "anr"]]}) AS name, unnest(range(8)) AS pos,
             unnest([{", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN NULL ELSE corr({c}, is_big) END" for c in [*_NUM, *[f"l_returnflag_{v}" for v in "anr"]])}]) AS v FROM done)),
n AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM kept) AS b, (SELECT count(*) FROM done) AS c)"""

_STEPS = (("load", "a", "a"), ("drop_columns", "a", "a"), ("handle_outliers", "a", "b"), ("impute_missing", "b", "c"), ("encode_features", "c", "c"),
          ("filter_by_correlation", "c", "c"), ("finalize_preparation", "NULL", "NULL"))

PREP_FULL_LOG = _with_full(_PREPARED, " UNION ALL ".join(
    f"SELECT {i} AS seq, '{t}' AS tool, {b} AS rows_before, {a} AS rows_after FROM n" for i, (t, b, a) in enumerate(_STEPS, 1))
    + " UNION ALL SELECT 99, string_agg(name, ',' ORDER BY pos), NULL, NULL FROM w WHERE v >= 0.05")


# ---- candidates
_RULES = f"""th AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{m}', {t})" for i, (m, t) in enumerate(RULES, 1))}) AS x(seq, method, t)),
p AS (SELECT seq, l_linestatus AS a, CASE WHEN score * 50 > t THEN 'O' ELSE 'F' END AS p, count(*) AS n FROM fx, th GROUP BY ALL),
c AS (SELECT seq, k, coalesce(sum(n) FILTER (a = k AND p = k), 0) AS tp, sum(n) FILTER (a = k) AS support, coalesce(sum(n) FILTER (p = k), 0) AS npred
      FROM p, (VALUES ('F'), ('O')) AS x(k) GROUP BY ALL),
f1 AS (SELECT seq, method, 'candidate_' || seq AS candidate_id,
              (SELECT sum(support * CASE WHEN tp > 0 THEN 2.0 * tp / (npred + support) ELSE 0 END) / sum(support) FROM c WHERE c.seq = th.seq) AS f FROM th)"""

CANDIDATE_SEAT = with_fx("fx_rule_scores", """
SELECT 'reference' AS policy, candidate_id, method, round(f, 6) AS validation_f1 FROM (
  SELECT * FROM f1 WHERE seq = 1 OR (method <> 'baseline' AND round(f, 12) >= (SELECT round(f, 12) FROM f1 WHERE seq = 1))
  ORDER BY seq = 1, round(f, 12) DESC, seq DESC LIMIT 1)
UNION ALL SELECT 'max_val_f1', candidate_id, method, round(f, 6) FROM (SELECT * FROM f1 ORDER BY round(f, 12) DESC, seq LIMIT 1)
UNION ALL SELECT 'explicit', candidate_id, method, round(f, 6) FROM f1 WHERE seq = 4""", ", " + _RULES)

_WHY = "The rule scorer is no better than chance on the test split."
_DEFAULT = ["Review feature engineering and class balance in the preparation report", "Tune hyperparameters or try alternative models",
            "Collect more data for underrepresented classes", "Re-run the pipeline after adjustments"]
_SUGGESTED = "CASE WHEN test_f1_meets_minimum AND f1_gap_within_limit THEN 'DEPLOY' ELSE 'DO NOT DEPLOY' END"

FAILURE_REPORT = with_fx("fx_rule_scores", f"""
SELECT 'metrics' AS section, 'test_f1' AS item, printf('%.4f', test_f1) AS value FROM sig
UNION ALL SELECT 'metrics', 'f1_gap', printf('%.4f', f1_gap) FROM sig
UNION ALL SELECT 'verdict', 'suggested_verdict', {_SUGGESTED} FROM sig
UNION ALL SELECT 'verdict', 'verdict', 'DO NOT DEPLOY' FROM sig
UNION ALL SELECT 'rationale', 'rationale', '{_WHY}' FROM sig
""" + "".join(f"UNION ALL SELECT 'next steps', '{i}', '{s}' FROM sig " for i, s in enumerate(_DEFAULT, 1)), _SIG)

STAGE_FAILURES = with_fx("fx_high", """
SELECT 'prep' AS stage, 'null_free_features' AS "check", CAST(NULL AS VARCHAR) AS column_name, count(*) AS n FROM fx WHERE l_orderkey % 10 = 0
UNION ALL SELECT * FROM (VALUES ('split', 'non_empty', 'test', 0), ('split', 'min_rows', 'test', 0), ('split', 'binary_target', 'test.is_high', 0),
  ('train', 'bundle_key', 'classes', 0), ('train', 'model', NULL, 0), ('train', 'validation_f1', NULL, 1), ('train', 'decisions', NULL, 0),
  ('evaluate', 'metrics', 'train', 0), ('evaluate', 'rationale', NULL, 0), ('deploy', 'remediation', 'do_not_deploy', 0)) AS v
UNION ALL SELECT 'deploy', 'scored_rows', 'do_not_deploy', count(*) FROM fx""")

# ---- the report
_METRICS = ("accuracy", "precision_weighted", "recall_weighted", "f1_weighted")


def _side(side: str) -> str:
    return f"""
{side}_c AS (SELECT k, coalesce(count(*) FILTER (l_linestatus = k AND prediction = k), 0) AS tp, count(*) FILTER (l_linestatus = k) AS support,
                    count(*) FILTER (prediction = k) AS npred FROM rr, (VALUES ('F'), ('O')) AS x(k) WHERE side = '{side}' GROUP BY k),
{side}_m AS (SELECT sum(tp) / sum(support) AS accuracy, sum(support * coalesce(tp / nullif(npred, 0), 0)) / sum(support) AS precision_weighted,
                    sum(tp) / sum(support) AS recall_weighted, sum(support * CASE WHEN tp > 0 THEN 2.0 * tp / (npred + support) ELSE 0 END) / sum(support) AS f1_weighted FROM {side}_c)"""


_RULE_SPLIT = f"""rs AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS prediction FROM lineitem),
rc AS (SELECT l_linestatus AS cls, count(*) AS n FROM rs GROUP BY 1),
rt AS (SELECT sum(n) AS total, sum(n) - ceil(0.3 * sum(n)) AS n_train FROM rc),
ra AS (SELECT cls, n / total * n_train AS cont FROM rc, rt),
rl AS (SELECT cls, floor(cont) + CASE WHEN row_number() OVER (ORDER BY cont - floor(cont) DESC, cls) <= (SELECT n_train FROM rt) - (SELECT sum(floor(cont)) FROM ra) THEN 1 ELSE 0 END AS n_cut FROM ra),
rr AS (SELECT rs.*, CASE WHEN row_number() OVER (PARTITION BY l_linestatus ORDER BY {md5_key(_LK)}) <= n_cut THEN 'train' ELSE 'test' END AS side FROM rs JOIN rl ON rl.cls = rs.l_linestatus),
{_side("train")}, {_side("test")},
ms AS (SELECT 'train' AS split, * FROM train_m UNION ALL SELECT 'test', * FROM test_m),
v AS (SELECT test_m.f1_weighted AS test_f1, abs(train_m.f1_weighted - test_m.f1_weighted) AS f1_gap FROM train_m, test_m),
vs AS (SELECT *, CASE WHEN test_f1 >= 0.7 AND f1_gap <= 0.05 THEN 'DEPLOY' ELSE 'DO NOT DEPLOY' END AS suggested FROM v)"""

_VERDICT_ROWS = (("test_f1", "printf('%.4f', test_f1)"), ("f1_gap", "printf('%.4f', f1_gap)"), ("suggested_verdict", "suggested"), ("verdict", "'DO NOT DEPLOY'"),
                 ("overrides_suggestion", "CASE WHEN suggested <> 'DO NOT DEPLOY' THEN 'true' ELSE 'false' END"), ("rationale", f"'{_WHY}'"))

RUN_REPORT = _with_full(_PREPARED + ", " + _RULE_SPLIT, " UNION ALL ".join(
    [f"SELECT 'prep' AS stage, {i} AS position, 'steps' AS section, '{t}' AS item, '(' || coalesce(CAST({b} AS VARCHAR), '?') || ' -> ' || coalesce(CAST({a} AS VARCHAR), '?') || ' rows)' AS value FROM n"
     for i, (t, b, a) in enumerate(_STEPS, 1)]
    + ["SELECT 'train', 1001, 'decisions', 'algorithm choice', 'rule (A rule on the quantity needs no training at all.)'",
       "SELECT 'prep', 2000, 'schema', 'l_returnflag', 'categorical, 3 categories' WHERE EXISTS (SELECT 1 FROM w WHERE name LIKE 'l_returnflag%' AND v >= 0.05)",
       "SELECT 'prep', 2000, 'schema', name, 'numeric' FROM w WHERE name NOT LIKE 'l_returnflag%' AND v >= 0.05"]
    + [f"SELECT 'evaluate', {3000 + i}, 'metrics', split || ' {m}', printf('%.4f', {m}) FROM ms" for i, m in enumerate(_METRICS)]
    + [f"SELECT 'evaluate', {4000 + i}, 'verdict', '{n}', {e} FROM vs" for i, (n, e) in enumerate(_VERDICT_ROWS)]
    + [f"SELECT 'deploy', {5000 + i}, 'next steps', '{i}', '{s}'" for i, s in enumerate(_DEFAULT, 1)]))

EVALUATION_CONTEXT = with_fx("fx_rule_scores", """
SELECT sum(n) AS rows, count(*) AS n_classes, max(n) AS majority_count, min(n) AS minority_count, 'candidate_1' AS candidate_id, CAST(0.7 AS DOUBLE) AS deploy_min_f1,
       CAST(0.05 AS DOUBLE) AS deploy_max_f1_gap, false AS has_probabilities, 'accuracy,precision_weighted,recall_weighted,f1_weighted' AS supported_metrics,
       CAST(0.6 AS DOUBLE) AS confidence_threshold FROM (SELECT l_linestatus, count(*) AS n FROM fx GROUP BY 1)""")

SCHEMA_SUMMARY = with_fx("fx_redundant", f"""
SELECT 8 AS field_count, 'l_quantity,l_extendedprice,l_discount,l_tax,l_charge,k' AS numeric_fields,
       'l_returnflag(' || (SELECT count(DISTINCT {clean("l_returnflag")}) FROM fx) || '),l_linestatus(' || (SELECT count(DISTINCT {clean("l_linestatus")}) FROM fx) || ')' AS categorical_fields""")

_TUNABLE = {"random_forest": ("n_estimators", "max_depth", "min_samples_leaf", "max_samples", "criterion"), "logistic_regression": ("C", "penalty", "solver"),
            "gradient_boosting": ("n_estimators", "learning_rate", "max_depth", "min_samples_leaf")}
RECOMMENDED_SEARCH = with_fx("fx_high", "SELECT rows, algorithm, position, parameter, 200 AS max_grid_combinations FROM r JOIN (VALUES " + ", ".join(
    f"('{a}', {i}, '{p}')" for a, ps in _TUNABLE.items() for i, p in enumerate(ps, 1)) + ") AS t(a, position, parameter) ON a = algorithm",
    ", r AS (SELECT count(*) AS rows, CASE WHEN count(*) < 1000 THEN 'logistic_regression' WHEN count(*) < 5000 THEN 'random_forest' ELSE 'gradient_boosting' END AS algorithm FROM fx)")

WIDE_CATEGORIES = """
WITH v AS (SELECT DISTINCT 0 AS o, c_name AS v FROM customer UNION ALL SELECT DISTINCT 1, c_mktsegment FROM customer),
i AS (SELECT o, v, row_number() OVER (ORDER BY o, encode(v)) - 1 AS p FROM v)
SELECT c_custkey, (SELECT count(*) FROM i) AS size, a.p || ',' || b.p AS positions
FROM customer JOIN i a ON a.o = 0 AND a.v = c_name JOIN i b ON b.o = 1 AND b.v = c_mktsegment"""

VALIDATION_SPLIT = with_fx("fx_high", f"""
SELECT {K}, is_high, CASE WHEN rk < alloc.n_cut THEN 'fit' ELSE 'validation' END AS part
FROM r JOIN alloc ON CAST(r.is_high AS VARCHAR) = alloc.cls""", _strat_alloc(0.2))

COERCE_STRICT = with_fx("fx_dirty", f"""
SELECT {K}, round(CAST({clean('qty_text')} AS DOUBLE), 6) AS qty_text, {clean('"Status "', '"Status"')} FROM fx""")

ORACLE_SQL = {"row_continuity": ROW_CONTINUITY, "split_written": SPLIT_WRITTEN, "fitted_apply": FITTED_APPLY, "prep_full_log": PREP_FULL_LOG, "candidate_seat": CANDIDATE_SEAT,
              "failure_report": FAILURE_REPORT, "stage_failures": STAGE_FAILURES, "run_report": RUN_REPORT, "evaluation_context": EVALUATION_CONTEXT,
              "schema_summary": SCHEMA_SUMMARY, "recommended_search": RECOMMENDED_SEARCH, "wide_categories": WIDE_CATEGORIES,
              "validation_split": VALIDATION_SPLIT, "coerce_strict": COERCE_STRICT}

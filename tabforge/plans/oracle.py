"""DuckDB SQL that must return the same rows as each registered query.

The SQL is written independently of the Spark code: statistics come from
DuckDB's own aggregates (``quantile_cont``, ``corr``, ``count(DISTINCT)``),
floats are rounded to 6 dp as the Spark side does.
"""

from __future__ import annotations

from tabforge.fixtures import FX_SQL

K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def clean(x: str, alias: str | None = None) -> str:
    """trim (any whitespace) -> lower -> 'nan'/'none'/'' become NULL."""
    t = f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"
    return f"CASE WHEN {t} IN ('nan', 'none', '') THEN NULL ELSE {t} END" + (f" AS {alias}" if alias else "")


def r6(x: str, alias: str) -> str:
    return f"round({x}, 6) AS {alias}"


def with_fx(name: str, body: str, extra: str = "") -> str:
    return f"WITH fx AS ({FX_SQL[name]}){extra} {body}"


# ----------------------------------------------------------------- step 1
NORMALIZE_STRINGS = with_fx("fx_dirty", f"""
SELECT {K}, {clean('rf_dirty', 'rf_dirty')}, {clean('qty_text', 'qty_text')},
       {clean('mixed_text', 'mixed_text')}, {clean('"Status "', '"Status"')} FROM fx""")

COERCE_NUMERIC = with_fx("fx_dirty", f"""
SELECT {K}, {clean('rf_dirty', 'rf_dirty')},
       round(CAST({clean('qty_text')} AS DOUBLE), 6) AS qty_text,
       {clean('"Status "', '"Status"')} FROM fx""")

_NULL_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
NULL_REPORT = with_fx("fx_nulls", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM fx" for c in _NULL_COLS)
    + ") WHERE null_count > 0")

_ID_PATTERNS = [r"\bid\b", r"\bname\b", r"\bphone\b", r"\baddress\b", r"\bdocument\b", r"\bdoc\b",
                r"\bemail\b", r"\bpassport\b", r"\bssn\b", r"\bcustomer_?id\b", r"\buser_?id\b",
                r"\bpatient_?id\b", r"^unnamed", r"^_c\d+$"]
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
ID_LIKE_COLUMNS = ("SELECT table_name, column_name, ("
                   + " OR ".join(f"regexp_matches(lower(trim(column_name)), '{p}')" for p in _ID_PATTERNS)
                   + ") AS id_like FROM information_schema.columns WHERE table_name IN ("
                   + ", ".join(f"'{t}'" for t in _TABLES) + ")")

_HIGH_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_charge"]
QUALITY_CHECKS = with_fx("fx_high", """
SELECT * FROM (
  SELECT 'non_empty' AS "check", CAST(NULL AS VARCHAR) AS column_name, rows AS n, rows > 0 AS ok FROM a
  UNION ALL SELECT 'target_present', 'is_high', 1, true FROM a
  UNION ALL SELECT 'min_rows', NULL, rows, rows >= 10 FROM a
  UNION ALL SELECT 'binary_target', 'is_high', classes, classes = 2 FROM a
  UNION ALL SELECT 'has_features', NULL, 6, true FROM a
  UNION ALL SELECT 'numeric_features', 'l_returnflag', 1, false FROM a
  UNION ALL SELECT 'null_free_features', NULL, null_rows, null_rows = 0 FROM a)""",
    ", a AS (SELECT count(*) AS rows, count(DISTINCT is_high) AS classes, count(*) FILTER (WHERE "
    + " OR ".join(f"{c} IS NULL" for c in _HIGH_FEATS) + ") AS null_rows FROM fx)")

# ----------------------------------------------------------------- step 2
_NUM_NULLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_prof = []
for _i, _c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]):
    _num = _c in _NUM_NULLS
    _src = _c if _num else clean(_c)
    _prof.append(
        f"SELECT {_i} AS pos, '{_c}' AS column_name, '{'double' if _num else 'string'}' AS dtype, "
        f"{'NULL' if _c == 'l_linestatus' else repr('numeric' if _num else 'categorical')} AS kind, "
        f"round(count(*) FILTER (WHERE {_src} IS NULL) / count(*), 4) AS missing_pct, "
        f"count(DISTINCT {_src}) AS nunique, "
        f"{'round(avg(' + _c + '), 7)' if _num else 'CAST(NULL AS DOUBLE)'} AS mean FROM fx")
PROFILE_COLUMNS = with_fx("fx_nulls", " UNION ALL ".join(_prof))

TOP_VALUES = with_fx("fx_nulls", """
SELECT 'l_returnflag' AS column_name, value, n,
       CAST(row_number() OVER (ORDER BY n DESC, value ASC NULLS LAST) AS INTEGER) AS rank
FROM v QUALIFY rank <= 5""", f", v AS (SELECT {clean('l_returnflag')} AS value, count(*) AS n FROM fx GROUP BY 1)")

CLASS_BALANCE = with_fx("fx_imbalanced", """
SELECT target_class, n, max(n) OVER () AS majority, min(n) OVER () AS minority,
       coalesce(round(min(n) OVER () / max(n) OVER (), 4), 1.0) AS ratio,
       coalesce(count(target_class) OVER () >= 2
                AND min(n) FILTER (WHERE target_class IS NOT NULL) OVER ()
                    / max(n) FILTER (WHERE target_class IS NOT NULL) OVER () < 0.4, false) AS imbalanced
FROM c""", ", c AS (SELECT CAST(quality AS VARCHAR) AS target_class, count(*) AS n FROM fx GROUP BY 1)")

_FENCE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_charge"]


def _fences(cols, src="fx"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src}"
        for c in cols)


IQR_FENCES = with_fx("fx_high", """
SELECT column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
       round(q1 - 3 * (q3 - q1), 6) AS lower, round(q3 + 3 * (q3 - q1), 6) AS upper, q3 - q1 > 0 AS applies
FROM f""", f", f AS ({_fences(_FENCE_COLS)})")

PREP_RECOMMENDATIONS = with_fx("fx_imbalanced", f"""
SELECT a.rows, '' AS id_like_columns, a.has_missing AS apply_imputation,
       'one_hot_drop_first' AS suggested_encoding,
       CASE WHEN c.mn / c.mx < 0.4 THEN 'smotenc' ELSE 'none' END AS suggested_balance,
       round(c.mn / c.mx, 4) AS class_ratio
FROM (SELECT count(*) AS rows, bool_or(n_chars IS NULL OR {clean('lang')} IS NULL OR {clean('source')} IS NULL)
             AS has_missing FROM fx) a,
     (SELECT max(n) AS mx, min(n) AS mn FROM (SELECT quality, count(*) AS n FROM fx GROUP BY 1)) c""")

# ----------------------------------------------------------------- step 3
_EV_FENCE = ", f AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM fx)"
OUTLIERS_REMOVE = with_fx("fx_outliers", f"""
SELECT event_id, round(value, 6) AS value, {clean('event_type', 'event_type')}, is_error FROM fx, f
WHERE NOT coalesce(q3 - q1 > 0 AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)), false)""", _EV_FENCE)

OUTLIERS_CAP = with_fx("fx_outliers", f"""
SELECT event_id,
       round(CASE WHEN q3 - q1 > 0 AND value < q1 - 3 * (q3 - q1) THEN q1 - 3 * (q3 - q1)
                  WHEN q3 - q1 > 0 AND value > q3 + 3 * (q3 - q1) THEN q3 + 3 * (q3 - q1)
                  ELSE value END, 6) AS value,
       {clean('event_type', 'event_type')}, is_error FROM fx, f""", _EV_FENCE)

_NULLS_CLEAN = (f", c AS (SELECT {K}, l_quantity, l_extendedprice, l_discount, l_tax, "
                f"{clean('l_returnflag', 'l_returnflag')}, {clean('l_linestatus', 'l_linestatus')} FROM fx)")
_RF_MODE = (", rfm AS (SELECT l_returnflag AS m FROM c WHERE l_returnflag IS NOT NULL GROUP BY 1 "
            "ORDER BY count(*) DESC, l_returnflag LIMIT 1)")
IMPUTE_MEDIAN = with_fx("fx_nulls", f"""
SELECT {K}, round(coalesce(l_quantity, med), 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
       round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax,
       coalesce(l_returnflag, rfm.m) AS l_returnflag, l_linestatus
FROM c, rfm, (SELECT quantile_cont(l_quantity, 0.5) AS med FROM c) md
WHERE l_linestatus IS NOT NULL""", _NULLS_CLEAN + _RF_MODE)

IMPUTE_MODE = with_fx("fx_nulls", f"""
SELECT {K}, round(coalesce(l_quantity, qm.m), 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
       round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax,
       coalesce(l_returnflag, rfm.m) AS l_returnflag, l_linestatus
FROM c, rfm, (SELECT l_quantity AS m FROM c WHERE l_quantity IS NOT NULL GROUP BY 1
              ORDER BY count(*) DESC, l_quantity LIMIT 1) qm
WHERE l_linestatus IS NOT NULL""", _NULLS_CLEAN + _RF_MODE)

DROP_NULL_ROWS = with_fx("fx_nulls", f"""
SELECT {K}, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
       round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus FROM c
WHERE l_quantity IS NOT NULL AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL""", _NULLS_CLEAN)

# ----------------------------------------------------------------- step 4
_RED_NUM = (f"{K}, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, "
            "round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, round(l_charge, 6) AS l_charge, "
            "round(k, 6) AS k")


def dummy(c: str, v: str) -> str:
    return f"CAST(coalesce({clean(c)} = '{v}', false) AS INTEGER) AS {c}_{v}"


ONE_HOT_DROP_FIRST = with_fx("fx_redundant", f"""
SELECT {_RED_NUM}, {dummy('l_returnflag', 'a')}, {dummy('l_returnflag', 'n')}, {dummy('l_returnflag', 'r')},
       {dummy('l_linestatus', 'o')}, is_big FROM fx""")

ONE_HOT_FULL = with_fx("fx_redundant", f"""
SELECT {_RED_NUM}, {dummy('l_returnflag', 'a')}, {dummy('l_returnflag', 'n')}, {dummy('l_returnflag', 'r')},
       {dummy('l_linestatus', 'f')}, {dummy('l_linestatus', 'o')}, is_big FROM fx""")

_CATS = lambda c: f"(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT {clean(c)} AS v FROM fx WHERE v IS NOT NULL))"
_DUMS = lambda c, keep_first: (
    f"(SELECT string_agg('{c}_' || v, ',' ORDER BY v) FROM (SELECT DISTINCT {clean(c)} AS v FROM fx "
    f"WHERE v IS NOT NULL) WHERE {'true' if keep_first else f'v > (SELECT min({clean(c)}) FROM fx)'})")
INPUT_SCHEMA = with_fx("fx_redundant", f"""
SELECT 0 AS pos, 'l_returnflag' AS name, 'categorical' AS type, {_CATS('l_returnflag')} AS categories,
       false AS drop_first, {_DUMS('l_returnflag', True)} AS dummy_columns
UNION ALL SELECT 1, 'l_linestatus', 'categorical', {_CATS('l_linestatus')}, true, {_DUMS('l_linestatus', False)}
""" + "".join(f"UNION ALL SELECT {i + 2}, '{c}', 'numeric', NULL, NULL, NULL\n"
              for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_charge", "k"])))

LABEL_INDEX = f"""
SELECT target_class, CAST(row_number() OVER (ORDER BY target_class) - 1 AS INTEGER) AS label_index
FROM (SELECT DISTINCT {clean('o_orderstatus')} AS target_class FROM orders) WHERE target_class IS NOT NULL"""

_RED_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_charge", "k"]


def _abs_corr(a: str, b: str) -> str:
    return (f"CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL "
            f"ELSE round(abs(corr({a}, {b})), 6) END")


CORR_MATRIX = with_fx("fx_redundant", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_abs_corr(a, b)} AS abs_r FROM fx"
    for i, a in enumerate(_RED_FEATS) for b in _RED_FEATS[i + 1:]))

TARGET_CORR = with_fx("fx_redundant", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_abs_corr(c, 'is_big')} AS abs_r FROM fx" for c in _RED_FEATS))

SELECT_FEATURES = with_fx("fx_high", f"""
SELECT {K}, round(l_discount, 6) AS l_discount, round(l_charge, 6) AS l_charge, is_high FROM fx""")

_INSIDE = "NOT EXISTS (SELECT 1 FROM f WHERE q3 - q1 > 0 AND (" + " OR ".join(
    f"(f.column_name = '{c}' AND (fx.{c} < q1 - 3 * (q3 - q1) OR fx.{c} > q3 + 3 * (q3 - q1)))" for c in _FENCE_COLS) + "))"
PREP_FLOW = with_fx("fx_high", f"""
SELECT {K}, round(l_discount, 6) AS l_discount, round(l_charge, 6) AS l_charge, is_high FROM fx WHERE {_INSIDE}""",
                    f", f AS ({_fences(_FENCE_COLS)})")

# ----------------------------------------------------------------- step 5
def md5_key(keys, seed=42):
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(
        f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys) + "))"


_LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_HIGH_OUT = (f"{K}, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, "
             "round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax, "
             f"{clean('l_returnflag', 'l_returnflag')}, round(l_charge, 6) AS l_charge, is_high")

UNDERSAMPLE = with_fx("fx_imbalanced", f"""
SELECT doc_id, n_chars, {clean('lang', 'lang')}, {clean('source', 'source')}, quality FROM (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {md5_key(['doc_id'])}, doc_id) - 1 AS rk FROM fx)
WHERE rk < (SELECT min(n) FROM (SELECT count(*) AS n FROM fx GROUP BY quality))""")

SPLIT_RANDOM = with_fx("fx_high", f"""
SELECT {_HIGH_OUT}, CASE WHEN rk < (SELECT count(*) - ceil(0.2 * count(*)) FROM fx) THEN 'train' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {md5_key(_LK)}, {K}) - 1 AS rk FROM fx)""")


def _strat_alloc(test_size: float) -> str:
    return f""",
c AS (SELECT CAST(is_high AS VARCHAR) AS cls, count(*) AS n FROM fx GROUP BY 1),
t AS (SELECT sum(n) AS total, sum(n) - ceil({test_size} * sum(n)) AS n_train FROM c),
a AS (SELECT cls, n / total * n_train AS cont FROM c, t),
fl AS (SELECT cls, floor(cont) AS base, cont - floor(cont) AS rem FROM a),
alloc AS (SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls)
                                   <= (SELECT n_train FROM t) - (SELECT sum(base) FROM fl) THEN 1 ELSE 0 END AS n_cut
          FROM fl),
r AS (SELECT *, row_number() OVER (PARTITION BY is_high ORDER BY {md5_key(_LK)}, {K}) - 1 AS rk FROM fx)"""


SPLIT_STRATIFIED = with_fx("fx_high", f"""
SELECT {_HIGH_OUT}, CASE WHEN rk < alloc.n_cut THEN 'train' ELSE 'test' END AS split
FROM r JOIN alloc ON CAST(r.is_high AS VARCHAR) = alloc.cls""", _strat_alloc(0.3))

KFOLD_ASSIGN = with_fx("fx_high", f"""
SELECT {_HIGH_OUT}, CAST((o.off + rk) % 5 AS INTEGER) AS fold
FROM r JOIN (SELECT cls, coalesce(sum(n) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
             FROM c) o ON CAST(r.is_high AS VARCHAR) = o.cls""",
    f""", c AS (SELECT CAST(is_high AS VARCHAR) AS cls, count(*) AS n FROM fx GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY is_high ORDER BY {md5_key(_LK)}, {K}) - 1 AS rk FROM fx)""")

CLASS_DRIFT = with_fx("fx_high", """
SELECT target_class, n_train, n_test, round(pt, 4) AS train_pct, round(pe, 4) AS test_pct,
       round(abs(pt - pe), 4) AS drift, max(round(abs(pt - pe), 4)) OVER () AS max_drift,
       max(round(abs(pt - pe), 4)) OVER () > 0.05 AS exceeds
FROM (SELECT target_class, n_train, n_test, n_train / sum(n_train) OVER () AS pt, n_test / sum(n_test) OVER () AS pe
      FROM (SELECT CAST(is_high AS VARCHAR) AS target_class,
                   count(*) FILTER (WHERE split = 'train') AS n_train,
                   count(*) FILTER (WHERE split = 'test') AS n_test
            FROM (SELECT r.is_high, CASE WHEN rk < alloc.n_cut THEN 'train' ELSE 'test' END AS split
                  FROM r JOIN alloc ON CAST(r.is_high AS VARCHAR) = alloc.cls) GROUP BY 1))""", _strat_alloc(0.3))

SPLIT_RECOMMENDATION = with_fx("fx_high", """
SELECT rows, majority_count, minority_count, coalesce(round(minority_count / majority_count, 4), 1.0) AS ratio,
       CASE WHEN rows < 5000 THEN 0.2 WHEN rows < 20000 THEN 0.25 ELSE 0.3 END::DOUBLE AS test_size,
       minority_count >= 2 AS stratify, 42 AS random_state
FROM (SELECT sum(n) AS rows, max(n) AS majority_count, min(n) AS minority_count
      FROM (SELECT is_high, count(*) AS n FROM fx WHERE is_high IS NOT NULL GROUP BY 1))""")

# ----------------------------------------------------------------- step 6
_CONF = """, cnt AS (SELECT l_linestatus AS actual, prediction AS predicted, count(*) AS n FROM fx GROUP BY 1, 2),
cls AS (SELECT actual AS c FROM cnt UNION SELECT predicted FROM cnt),
conf AS (SELECT a.c AS actual, p.c AS predicted, coalesce(cnt.n, 0) AS n FROM cls a CROSS JOIN cls p
         LEFT JOIN cnt ON cnt.actual = a.c AND cnt.predicted = p.c),
pc AS (SELECT c, tp, support, npred,
              coalesce(tp / nullif(npred, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall
       FROM (SELECT cls.c,
                    (SELECT sum(n) FROM conf WHERE actual = cls.c AND predicted = cls.c) AS tp,
                    (SELECT sum(n) FROM conf WHERE actual = cls.c) AS support,
                    (SELECT sum(n) FROM conf WHERE predicted = cls.c) AS npred FROM cls)),
pcf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1
        FROM pc)"""

CONFUSION_MATRIX = with_fx("fx_rule_scores", "SELECT actual, predicted, n FROM conf", _CONF)

WEIGHTED_METRICS = with_fx("fx_rule_scores", """
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision_weighted,
       round(sum(recall * support) / sum(support), 6) AS recall_weighted,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM pcf""", _CONF)

CLASSIFICATION_REPORT = with_fx("fx_rule_scores", """
SELECT c AS row_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       support FROM pcf
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support) FROM pcf
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support) FROM pcf
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)
FROM pcf""", _CONF)

_SCORES = """, sc AS (SELECT score AS s, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS pos,
                      sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS neg FROM fx GROUP BY 1),
cum AS (SELECT s, pos, neg,
               coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_gt,
               coalesce(sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_gt
        FROM sc)"""

ROC_POINTS = with_fx("fx_rule_scores", """
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL SELECT round(s, 6), round((neg_gt + neg) / (SELECT sum(neg) FROM sc), 6),
       round((pos_gt + pos) / (SELECT sum(pos) FROM sc), 6) FROM cum""", _SCORES)

ROC_AUC = with_fx("fx_rule_scores", """
SELECT round(sum(neg * (pos_gt + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM cum""", _SCORES)

# ----------------------------------------------------------------- step 7
_W = [0.02, 0.00001, -1.0, 2.0, 0.3, -0.2, 0.1]
_B = -1.2
_RAWN = "lower(regexp_replace(l_returnflag, '^\\s+|\\s+$', '', 'g'))"
_FEATS_SQL = ["coalesce(l_quantity, 0.0)", "coalesce(l_extendedprice, 0.0)", "coalesce(l_discount, 0.0)", "0.0",
              f"CAST(coalesce({_RAWN} = 'a', false) AS DOUBLE)", f"CAST(coalesce({_RAWN} = 'n', false) AS DOUBLE)",
              f"CAST(coalesce({_RAWN} = 'r', false) AS DOUBLE)"]
_FEAT_NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag_a", "l_returnflag_n",
               "l_returnflag_r"]

TRANSFORM_RAW = with_fx("fx_raw_new", f"SELECT {K}, " + ", ".join(
    f"round(CAST({e} AS DOUBLE), 6) AS {n}" for e, n in zip(_FEATS_SQL, _FEAT_NAMES)) + " FROM fx")

_Z = f"{_B}" + "".join(f" + {w} * {e}" for w, e in zip(_W, _FEATS_SQL))
_SCORED = f""", sc AS (SELECT *, 1.0 / (1.0 + exp(-({_Z}))) AS p1 FROM fx),
scored AS (SELECT *, greatest(p1, 1 - p1) AS conf, CASE WHEN p1 > 0.5 THEN 'o' ELSE 'f' END AS pred FROM sc)"""

SCORE_LINEAR = with_fx("fx_raw_new", f"""
SELECT {K}, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice,
       round(l_discount, 6) AS l_discount, l_returnflag, round(p1, 6) AS p_positive, pred AS prediction,
       round(conf, 6) AS confidence, conf < 0.6 AS low_confidence FROM scored""", _SCORED)

LOW_CONFIDENCE = with_fx("fx_raw_new", """
SELECT count(*) AS rows, count(*) FILTER (WHERE conf < 0.6) AS low_confidence_rows FROM scored""", _SCORED)

CLASS_PROBABILITIES = with_fx("fx_raw_new", f"""
SELECT {K}, 'f' AS class, round(1 - p1, 6) AS probability FROM scored
UNION ALL SELECT {K}, 'o', round(p1, 6) FROM scored""", _SCORED)

TRAIN_RECOMMENDATION = with_fx("fx_high", """
SELECT count(*) AS rows,
       CASE WHEN count(*) < 1000 THEN 'logistic_regression' WHEN count(*) < 5000 THEN 'random_forest'
            ELSE 'gradient_boosting' END AS algorithm,
       count(*) >= 1000 AS tune, 0.2 AS validation_size, 'f1_weighted' AS scoring FROM fx""")


# ----------------------------------------------------------------- step 10
def _split_ctes(target: str, keys, test_size: float) -> str:
    kk = ", ".join(keys)
    return f""",
sc_c AS (SELECT CAST({target} AS VARCHAR) AS cls, count(*) AS n FROM fx GROUP BY 1),
sc_t AS (SELECT sum(n) AS total, sum(n) - ceil({test_size} * sum(n)) AS n_train FROM sc_c),
sc_fl AS (SELECT cls, floor(n / total * n_train) AS base, n / total * n_train - floor(n / total * n_train) AS rem
          FROM sc_c, sc_t),
sc_alloc AS (SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls)
                                     <= (SELECT n_train FROM sc_t) - (SELECT sum(base) FROM sc_fl) THEN 1 ELSE 0 END
                     AS n_cut FROM sc_fl),
sp AS (SELECT r.*, CASE WHEN rk < a.n_cut THEN 'train' ELSE 'test' END AS split
       FROM (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY {md5_key(keys)}, {kk}) - 1 AS rk FROM fx) r
       JOIN sc_alloc a ON CAST(r.{target} AS VARCHAR) = a.cls)"""


def _f1_ctes(name: str, where: str, label: str, pred: str) -> str:
    return f""",
{name}_cnt AS (SELECT {label} AS actual, {pred} AS predicted, count(*) AS n FROM sp WHERE {where} GROUP BY 1, 2),
{name}_cls AS (SELECT actual AS c FROM {name}_cnt UNION SELECT predicted FROM {name}_cnt),
{name}_pc AS (SELECT c, coalesce((SELECT sum(n) FROM {name}_cnt WHERE actual = c AND predicted = c), 0) AS tp,
                     coalesce((SELECT sum(n) FROM {name}_cnt WHERE actual = c), 0) AS support,
                     coalesce((SELECT sum(n) FROM {name}_cnt WHERE predicted = c), 0) AS npred FROM {name}_cls),
{name}_m AS (SELECT sum(f1 * support) / sum(support) AS f1 FROM (
    SELECT support, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (
        SELECT support, coalesce(tp / nullif(npred, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r
        FROM {name}_pc)))"""


_SIG = (_split_ctes("l_linestatus", _LK, 0.3) + _f1_ctes("tr", "split = 'train'", "l_linestatus", "prediction")
        + _f1_ctes("te", "split = 'test'", "l_linestatus", "prediction") + """,
bal AS (SELECT max(n) AS majority_count, min(n) AS minority_count FROM (
        SELECT l_linestatus, count(*) AS n FROM sp WHERE split = 'test' AND l_linestatus IS NOT NULL GROUP BY 1)),
sig AS (SELECT tr_m.f1 AS train_f1, te_m.f1 AS test_f1, abs(tr_m.f1 - te_m.f1) AS f1_gap,
               te_m.f1 >= 0.7 AS test_f1_meets_minimum, abs(tr_m.f1 - te_m.f1) <= 0.05 AS f1_gap_within_limit,
               majority_count, minority_count FROM tr_m, te_m, bal)""")

DEPLOY_SIGNALS = with_fx("fx_rule_scores", """
SELECT round(train_f1, 6) AS train_f1, round(test_f1, 6) AS test_f1, round(f1_gap, 6) AS f1_gap,
       test_f1_meets_minimum, f1_gap_within_limit, majority_count, minority_count,
       coalesce(round(minority_count / majority_count, 4), 1.0) AS test_class_ratio,
       CAST(NULL AS DOUBLE) AS validation_to_test_f1_delta,
       CASE WHEN test_f1_meets_minimum AND f1_gap_within_limit THEN 'DEPLOY' ELSE 'DO NOT DEPLOY' END
           AS suggested_verdict,
       concat_ws('; ', CASE WHEN NOT test_f1_meets_minimum THEN 'test F1 below 0.7' END,
                       CASE WHEN NOT f1_gap_within_limit THEN 'train-test F1 gap above 0.05' END) AS signal_reasons
FROM sig""", _SIG)

DEPLOY_BRANCH = with_fx("fx_rule_scores", """
SELECT round(test_f1, 6) AS test_f1, round(f1_gap, 6) AS f1_gap, v AS suggested_verdict, 'DEPLOY' AS verdict,
       v <> 'DEPLOY' AS overrides_suggestion,
       'Reviewer accepts the rule scorer despite the low F1.' AS rationale, 'deploy' AS branch
FROM (SELECT *, CASE WHEN test_f1_meets_minimum AND f1_gap_within_limit THEN 'DEPLOY' ELSE 'DO NOT DEPLOY' END AS v
      FROM sig)""", _SIG)

_KEPT = ", kept AS (SELECT * FROM fx WHERE NOT EXISTS (SELECT 1 FROM f WHERE q3 - q1 > 0 AND (" + " OR ".join(
    f"(f.column_name = '{c}' AND (fx.{c} < q1 - 3 * (q3 - q1) OR fx.{c} > q3 + 3 * (q3 - q1)))"
    for c in _FENCE_COLS) + ")))"

RUN_LOG = with_fx("fx_high", """
SELECT 1 AS seq, 'load' AS tool, (SELECT count(*) FROM fx) AS rows_before, (SELECT count(*) FROM fx) AS rows_after
UNION ALL SELECT 2, 'drop_columns', (SELECT count(*) FROM fx), (SELECT count(*) FROM fx)
UNION ALL SELECT 3, 'handle_outliers', (SELECT count(*) FROM fx), (SELECT count(*) FROM kept)
UNION ALL SELECT 4, 'impute_missing', (SELECT count(*) FROM kept), (SELECT count(*) FROM kept WHERE is_high IS NOT NULL)
UNION ALL SELECT 5, 'encode_features', (SELECT count(*) FROM kept), (SELECT count(*) FROM kept)
UNION ALL SELECT 6, 'filter_by_correlation', (SELECT count(*) FROM kept), (SELECT count(*) FROM kept)
UNION ALL SELECT 7, 'finalize_preparation', NULL, NULL""", f", f AS ({_fences(_FENCE_COLS)})" + _KEPT)

STAGE_VALIDATION = with_fx("fx_high", """
SELECT * FROM (
  SELECT 'non_empty' AS "check", CAST(NULL AS VARCHAR) AS column_name, rows AS n, rows > 0 AS ok FROM a
  UNION ALL SELECT 'target_present', 'is_high', 1, true FROM a
  UNION ALL SELECT 'min_rows', NULL, rows, rows >= 10 FROM a
  UNION ALL SELECT 'binary_target', 'is_high', classes, classes = 2 FROM a
  UNION ALL SELECT 'has_features', NULL, 2, true FROM a
  UNION ALL SELECT 'numeric_features', NULL, 0, true FROM a
  UNION ALL SELECT 'null_free_features', NULL, null_rows, null_rows = 0 FROM a)""",
    f", f AS ({_fences(_FENCE_COLS)})" + _KEPT
    + ", a AS (SELECT count(*) AS rows, count(DISTINCT is_high) AS classes, "
      "count(*) FILTER (WHERE l_discount IS NULL OR l_charge IS NULL) AS null_rows FROM kept)")

# ----------------------------------------------------------------- step 8
# invariant: after balancing both classes have the majority count
SMOTENC_CLASS_COUNTS = with_fx("fx_imbalanced", """
SELECT quality, (SELECT max(n) FROM (SELECT count(*) AS n FROM fx GROUP BY quality)) AS n,
       'smotenc' AS method_applied
FROM (SELECT DISTINCT quality FROM fx)""")

# ------------------------------------------------------- tables between stages
CSV_LOAD = with_fx("fx_nulls", f"""
SELECT {K}, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount,
       round(l_tax, 6) AS l_tax, l_returnflag, l_linestatus FROM fx""")

STAGE_ROUNDTRIP = with_fx("fx_high", f"""
SELECT {K}, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount,
       round(l_tax, 6) AS l_tax, l_returnflag, round(l_charge, 6) AS l_charge, is_high FROM fx""")

BUNDLE_SCORE = with_fx("fx_high", "SELECT count(*) AS rows, 0 AS different FROM fx")

ROC_AUC_SKEWED = with_fx("fx_rule_scores", """
SELECT round(sum(neg * (pos_gt + pos / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM cum""",
                         _SCORES.replace("SELECT score AS s", "SELECT CASE WHEN score < 0.5 THEN score * 1e-9 ELSE 1 - score * 1e-9 END AS s"))

IQR_FENCES_EXTREME = with_fx("fx_high", """
SELECT column_name, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3
FROM (SELECT 'with_inf' AS column_name, CASE WHEN l_orderkey % 50 = 0 THEN CAST('inf' AS DOUBLE) WHEN l_orderkey % 77 = 0 THEN CAST('-inf' AS DOUBLE)
             ELSE l_extendedprice END AS v FROM fx
      UNION ALL SELECT 'wide', CASE WHEN l_orderkey % 3 = 0 THEN l_extendedprice * 1e6 WHEN l_orderkey % 3 = 1 THEN l_extendedprice
             ELSE l_quantity / 1024 END FROM fx) GROUP BY column_name""")

SPLIT_BALANCED = with_fx("fx_high", """
SELECT split, is_high, CAST(CASE WHEN split = 'train' THEN n_train // 2 + CASE WHEN is_high = 0 THEN n_train % 2 ELSE 0 END
       ELSE m - (n_train // 2 + CASE WHEN is_high = 0 THEN n_train % 2 ELSE 0 END) END AS BIGINT) AS n
FROM (SELECT m, 2 * m - CAST(ceil(0.2 * (2 * m)) AS BIGINT) AS n_train FROM (SELECT max(n) AS m FROM (SELECT count(*) AS n FROM fx GROUP BY is_high))),
     (VALUES ('train'), ('test')) s(split), (VALUES (0), (1)) h(is_high)""")


# --------------------------------------------------------- nearest neighbours
# the first 15 hex digits of a place's first row hash order places that are equally near, as in Spark
SMOTE_ROWS = with_fx("fx_high", f"""
SELECT CAST(NULL AS BIGINT) AS l_orderkey, CAST(NULL AS INTEGER) AS l_linenumber, CAST(NULL AS BIGINT) AS l_partkey, CAST(NULL AS BIGINT) AS l_suppkey,
       round(b.l_discount + u * (near.x - b.l_discount), 6) AS l_discount, round(b.l_charge + u * (near.y - b.l_charge), 6) AS l_charge, 1 AS is_high
FROM syn JOIN base b ON b.r = syn.r JOIN near ON near.qx = b.l_discount AND near.qy = b.l_charge AND syn.slot >= near.before AND syn.slot < near.before + near.m""",
    f""", f AS ({_fences(_FENCE_COLS)}), prep AS (SELECT * FROM fx WHERE {_INSIDE}),
base AS (SELECT *, {md5_key(_LK)} AS h, row_number() OVER (ORDER BY {md5_key(_LK)}) - 1 AS r FROM prep WHERE is_high = 1),
size AS (SELECT count(*) FILTER (is_high = 1) AS n_min, count(*) FILTER (is_high = 0) - count(*) FILTER (is_high = 1) AS need FROM prep),
place AS (SELECT l_discount AS x, l_charge AS y, count(*) AS m, substr(min(h), 1, 15) AS h FROM base GROUP BY 1, 2),
few AS (SELECT q.x AS qx, q.y AS qy, unnest(arg_min({{'x': p.x, 'y': p.y, 'm': p.m, 'h': p.h}},
          {{'d': sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), 'h': p.h}}, 7)) AS p FROM place q, place p GROUP BY 1, 2),
own AS (SELECT qx, qy, p.x AS x, p.y AS y, p.h AS h, p.m - CASE WHEN p.x = qx AND p.y = qy THEN 1 ELSE 0 END AS m FROM few),
near AS (SELECT qx, qy, x, y, m, coalesce(sum(m) OVER (PARTITION BY qx, qy ORDER BY sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)), h
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM own WHERE m > 0),
syn AS (SELECT o % n_min AS r, CAST('0x' || substr(md5('42|' || o), 1, 8) AS BIGINT) % 5 AS slot, CAST('0x' || substr(md5('42|' || o), 9, 8) AS BIGINT) / 4294967296.0 AS u
        FROM (SELECT unnest(range(need)) AS o, n_min FROM size))""")


def _knn_fill(c: str, by: str) -> str:
    return f"""
{c}_d AS (SELECT {by} AS x, {c} AS v, min(h) OVER (PARTITION BY {by}) AS first, row_number() OVER (PARTITION BY {by} ORDER BY h) AS slot
          FROM r WHERE {c} IS NOT NULL AND {by} IS NOT NULL QUALIFY slot <= 5),
{c}_q AS (SELECT DISTINCT {by} AS x FROM r WHERE {c} IS NULL AND {by} IS NOT NULL),
{c}_n AS (SELECT q.x, d.v FROM {c}_q q, {c}_d d
          QUALIFY row_number() OVER (PARTITION BY q.x ORDER BY sqrt((q.x - d.x) * (q.x - d.x) * 2.0), substr(d.first, 1, 15), d.slot) <= 5),
{c}_i AS (SELECT x, avg(v) AS v FROM {c}_n GROUP BY x)"""


KNN_IMPUTE = with_fx("fx_knn", f"""
SELECT {K}, round(coalesce(l_quantity, l_quantity_i.v, (SELECT avg(l_quantity) FROM fx)), 6) AS l_quantity,
       round(coalesce(l_discount, l_discount_i.v, (SELECT avg(l_discount) FROM fx)), 6) AS l_discount, round(l_tax, 6) AS l_tax, {clean('l_linestatus', 'l_linestatus')}
FROM r LEFT JOIN l_quantity_i ON l_quantity_i.x = r.l_discount LEFT JOIN l_discount_i ON l_discount_i.x = r.l_quantity WHERE l_linestatus IS NOT NULL""",
    f", r AS (SELECT *, {md5_key(_LK)} AS h FROM fx)," + _knn_fill("l_quantity", "l_discount") + "," + _knn_fill("l_discount", "l_quantity"))


ORACLE_SQL = {
    "csv_load": CSV_LOAD,
    "stage_roundtrip": STAGE_ROUNDTRIP,
    "schema_roundtrip": INPUT_SCHEMA,
    "bundle_score": BUNDLE_SCORE,
    "roc_auc_skewed": ROC_AUC_SKEWED,
    "iqr_fences_extreme": IQR_FENCES_EXTREME,
    "split_balanced": SPLIT_BALANCED,
    "normalize_strings": NORMALIZE_STRINGS,
    "coerce_numeric": COERCE_NUMERIC,
    "null_report": NULL_REPORT,
    "id_like_columns": ID_LIKE_COLUMNS,
    "quality_checks": QUALITY_CHECKS,
    "profile_columns": PROFILE_COLUMNS,
    "top_values": TOP_VALUES,
    "class_balance": CLASS_BALANCE,
    "iqr_fences": IQR_FENCES,
    "prep_recommendations": PREP_RECOMMENDATIONS,
    "outliers_remove": OUTLIERS_REMOVE,
    "outliers_cap": OUTLIERS_CAP,
    "impute_median": IMPUTE_MEDIAN,
    "impute_mode": IMPUTE_MODE,
    "drop_null_rows": DROP_NULL_ROWS,
    "one_hot_drop_first": ONE_HOT_DROP_FIRST,
    "one_hot_full": ONE_HOT_FULL,
    "input_schema": INPUT_SCHEMA,
    "label_index": LABEL_INDEX,
    "corr_matrix": CORR_MATRIX,
    "target_corr": TARGET_CORR,
    "select_features": SELECT_FEATURES,
    "prep_flow": PREP_FLOW,
    "undersample": UNDERSAMPLE,
    "split_random": SPLIT_RANDOM,
    "split_stratified": SPLIT_STRATIFIED,
    "kfold_assign": KFOLD_ASSIGN,
    "class_drift": CLASS_DRIFT,
    "split_recommendation": SPLIT_RECOMMENDATION,
    "confusion_matrix": CONFUSION_MATRIX,
    "weighted_metrics": WEIGHTED_METRICS,
    "classification_report": CLASSIFICATION_REPORT,
    "roc_points": ROC_POINTS,
    "roc_auc": ROC_AUC,
    "transform_raw": TRANSFORM_RAW,
    "score_linear": SCORE_LINEAR,
    "low_confidence": LOW_CONFIDENCE,
    "class_probabilities": CLASS_PROBABILITIES,
    "train_recommendation": TRAIN_RECOMMENDATION,
    "deploy_signals": DEPLOY_SIGNALS,
    "deploy_branch": DEPLOY_BRANCH,
    "run_log": RUN_LOG,
    "stage_validation": STAGE_VALIDATION,
    "stream_score_equals_batch": SCORE_LINEAR,
    "smotenc_class_counts": SMOTENC_CLASS_COUNTS,
    "smote_rows": SMOTE_ROWS,
    "knn_impute": KNN_IMPUTE,
}

"""Stand-in inputs derived from the driver tables.

Each fixture is a plain projection of one or two driver tables, given twice:
as a DataFrame builder (what the Spark queries read) and as SQL text (what
the DuckDB oracle reads).  They only shape rows into the schema an operator
expects; no operator work happens here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINEITEM_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _charge() -> F.Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def fx_lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *LINEITEM_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus")


def fx_high(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *LINEITEM_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", _charge().alias("l_charge"),
        (_charge() > 85000).cast("int").alias("is_high"))


def fx_nulls(spark, sf_dir):
    li = fx_lineitem(spark, sf_dir)
    return li.select(
        *LINEITEM_KEYS,
        F.when(F.col("l_orderkey") % 10 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_orderkey") % 1000 == 1, None).otherwise(F.col("l_linestatus")).alias("l_linestatus"))


def fx_redundant(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *LINEITEM_KEYS, "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", _charge().alias("l_charge"), F.lit(5.0).alias("k"),
        (_charge() * (1 + F.col("l_tax")) > 50000).cast("int").alias("is_big"))


def fx_dirty(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rf = (F.when(F.col("l_orderkey") % 97 == 0, F.lit("NaN"))
          .when(F.col("l_orderkey") % 89 == 0, F.lit("None"))
          .when(F.col("l_orderkey") % 83 == 0, F.lit(""))
          .otherwise(F.concat(F.lit("  "), F.upper("l_returnflag"), F.lit(" "))))
    qty = F.concat(F.lit(" "), F.col("l_quantity").cast("string"))
    mixed = F.when(F.col("l_orderkey") % 101 == 0, F.lit("abc")).otherwise(F.col("l_tax").cast("string"))
    return li.select(*LINEITEM_KEYS, rf.alias("rf_dirty"), qty.alias("qty_text"),
                     mixed.alias("mixed_text"), F.upper("l_linestatus").alias("Status "))


def fx_knn(spark, sf_dir):
    """Two numeric columns with nulls (quantity, discount) for kNN imputation."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *LINEITEM_KEYS,
        F.when(F.col("l_orderkey") % 10 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 11 == 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_linestatus")


def fx_full(spark, sf_dir):
    """All that a preparation meets: nulls, outliers, an id-like column, a constant, a rare target null."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *LINEITEM_KEYS, F.col("l_suppkey").alias("user_id"),
        F.when(F.col("l_orderkey") % 10 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(F.col("l_partkey") % 97 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        "l_discount", "l_tax", F.lit(5.0).alias("k"),
        F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_orderkey") % 1000 == 1, None).otherwise((_charge() > 60000).cast("int")).alias("is_big"))


def fx_outliers(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "value", "event_type",
                     (F.col("event_type") == "error").cast("int").alias("is_error"))


def fx_imbalanced(spark, sf_dir):
    lb = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(lb, "doc_id").select("doc_id", "n_chars", "lang", "source", "quality")


def fx_three_class(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority",
                                                  "o_orderstatus")


def fx_rule_scores(spark, sf_dir):
    li = fx_lineitem(spark, sf_dir)
    return li.select(*LINEITEM_KEYS, "l_linestatus",
                     (F.col("l_quantity") / 50.0).alias("score"),
                     F.when(F.col("l_quantity") > 25, F.lit("O")).otherwise(F.lit("F")).alias("prediction"))


def fx_raw_new(spark, sf_dir):
    return raw_new_projection(table(spark, sf_dir, "lineitem"))


def raw_new_projection(li: DataFrame) -> DataFrame:
    """fx_raw_new as a projection of lineitem (works on a streaming lineitem too)."""
    return li.select(
        *LINEITEM_KEYS,
        F.when(F.col("l_orderkey") % 13 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount",
        F.when(F.col("l_orderkey") % 11 == 0, F.lit(" Z")).otherwise(F.col("l_returnflag")).alias("l_returnflag"))


# ---------------------------------------------------------------------------
# The same fixtures as DuckDB SQL (views named like the driver tables).
_K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_CHARGE = "l_extendedprice * (1 - l_discount)"

FX_SQL = {
    "fx_lineitem": f"SELECT {_K}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
    "fx_high": (f"SELECT {_K}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
                f"{_CHARGE} AS l_charge, CAST({_CHARGE} > 85000 AS INTEGER) AS is_high FROM lineitem"),
    "fx_nulls": (f"SELECT {_K}, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
                 "l_extendedprice, l_discount, l_tax, "
                 "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, "
                 "CASE WHEN l_orderkey % 1000 = 1 THEN NULL ELSE l_linestatus END AS l_linestatus FROM lineitem"),
    "fx_redundant": (f"SELECT {_K}, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
                     f"{_CHARGE} AS l_charge, 5.0::DOUBLE AS k, "
                     f"CAST({_CHARGE} * (1 + l_tax) > 50000 AS INTEGER) AS is_big FROM lineitem"),
    "fx_dirty": (f"SELECT {_K}, CASE WHEN l_orderkey % 97 = 0 THEN 'NaN' WHEN l_orderkey % 89 = 0 THEN 'None' "
                 "WHEN l_orderkey % 83 = 0 THEN '' ELSE '  ' || upper(l_returnflag) || ' ' END AS rf_dirty, "
                 "' ' || CAST(l_quantity AS VARCHAR) AS qty_text, "
                 "CASE WHEN l_orderkey % 101 = 0 THEN 'abc' ELSE CAST(l_tax AS VARCHAR) END AS mixed_text, "
                 "upper(l_linestatus) AS \"Status \" FROM lineitem"),
    "fx_outliers": "SELECT event_id, value, event_type, CAST(event_type = 'error' AS INTEGER) AS is_error FROM events",
    "fx_imbalanced": ("SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality FROM documents d "
                      "JOIN labels l ON d.doc_id = l.doc_id"),
    "fx_three_class": "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders",
    "fx_rule_scores": (f"SELECT {_K}, l_linestatus, l_quantity / 50.0 AS score, "
                       "CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS prediction FROM lineitem"),
    "fx_knn": (f"SELECT {_K}, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
               "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax, l_linestatus FROM lineitem"),
    "fx_full": (f"SELECT {_K}, l_suppkey AS user_id, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
                "CASE WHEN l_partkey % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice, l_discount, l_tax, "
                "CAST(5.0 AS DOUBLE) AS k, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag, "
                f"CASE WHEN l_orderkey % 1000 = 1 THEN NULL ELSE CAST({_CHARGE} > 60000 AS INTEGER) END AS is_big FROM lineitem"),
    "fx_raw_new": (f"SELECT {_K}, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity, "
                   "l_extendedprice, l_discount, "
                   "CASE WHEN l_orderkey % 11 = 0 THEN ' Z' ELSE l_returnflag END AS l_returnflag FROM lineitem"),
}

FIXTURES = {
    "fx_lineitem": fx_lineitem, "fx_high": fx_high, "fx_nulls": fx_nulls,
    "fx_redundant": fx_redundant, "fx_dirty": fx_dirty, "fx_outliers": fx_outliers,
    "fx_imbalanced": fx_imbalanced, "fx_three_class": fx_three_class,
    "fx_rule_scores": fx_rule_scores, "fx_raw_new": fx_raw_new, "fx_knn": fx_knn,
    "fx_full": fx_full,
}

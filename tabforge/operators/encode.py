"""One-hot encoding, feature schema, label index and raw-row transform.

Encoding is one ``select`` generated from the sorted category lists (a single
tall value-count pass), instead of one frame rebuild per category.  The raw
transform used for scoring is likewise one projection generated from the
stored schema, so batch and streaming scoring share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.constants import ENCODINGS
from tabforge.errors import DataError, ParamError
from tabforge.functions.exprs import col, is_numeric_type, parse_number, trim_all
from tabforge.operators import stats
from tabforge.operators.normalize import coerce_numeric, excluded_columns

SCHEMA_DDL = ("name string, type string, categories array<string>, drop_first boolean, "
              "dummy_columns array<string>")


def fit_one_hot(df: DataFrame, target: str, strategy: str = "one_hot_drop_first",
                keys: Sequence[str] = (), max_categories: int | None = None) -> dict:
    """Sorted categories and dummy names per categorical feature.  A column with
    more than ``max_categories`` values raises; None sets no limit."""
    if strategy not in ENCODINGS:
        raise ParamError(f"Unknown encoding strategy: {strategy}")
    cats = [c for c in df.columns if c != target and c not in keys
            and not is_numeric_type(df.schema[c].dataType)]
    categories = stats.sorted_categories(df, cats, max_categories)
    groups: dict[str, dict] = {}
    for c in cats:
        values = categories[c]
        drop_first = strategy == "one_hot_drop_first" and len(values) == 2
        kept = values[1:] if drop_first else values
        groups[c] = {"categories": values, "drop_first": drop_first,
                     "dummies": [(f"{c}_{v}", v) for v in kept]}
    names = [c for c in df.columns if c not in cats]
    for g in groups.values():
        names += [d for d, _ in g["dummies"]]
    dupes = sorted({n for n in names if names.count(n) > 1})
    if dupes:
        raise DataError(f"Dummy column names collide: {dupes}")
    return groups


def apply_one_hot(df: DataFrame, target: str, groups: dict, keys: Sequence[str] = ()) -> DataFrame:
    """Numeric columns in place, dummies (int 0/1, null -> 0) appended, target last."""
    kept = [c for c in df.columns if c not in groups and c != target]
    dummies = []
    for c, g in groups.items():
        for name, v in g["dummies"]:
            dummies.append(F.coalesce((col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(name))
    ordered_keys = [c for c in keys if c in kept]
    rest = [c for c in kept if c not in keys]
    return df.select(*[col(c) for c in ordered_keys + rest], *dummies, col(target))


def one_hot(df: DataFrame, target: str, strategy: str = "one_hot_drop_first",
            keys: Sequence[str] = (), max_categories: int | None = None) -> tuple[DataFrame, dict]:
    groups = fit_one_hot(df, target, strategy, keys, max_categories)
    return apply_one_hot(df, target, groups, keys), groups


def encode_features(df: DataFrame, strategy: str, target: str, keys: Sequence[str] = (),
                    manual_drops: Sequence[str] = (), allow_nulls: bool = False,
                    max_categories: int | None = None) -> tuple[DataFrame, dict]:
    """null guard, lenient numeric coercion, id/manual exclusion, one-hot.

    Returns the encoded table and ``{"groups", "excluded", "pre_encode"}``;
    ``pre_encode`` is the (lazy) table the schema is later built from.
    """
    if strategy not in ENCODINGS:
        raise ParamError(f"Unknown encoding strategy: {strategy}")
    feats = [c for c in df.columns if c != target and c not in keys]
    if not allow_nulls:
        from tabforge.operators.impute import columns_with_nulls
        with_nulls = columns_with_nulls(df, feats)
        if with_nulls:
            raise DataError(f"Features have nulls {with_nulls}; impute before encoding.")
    df, converted = coerce_numeric(df, target, keys)
    exclude = excluded_columns(df.drop(*keys) if keys else df, target, manual_drops)
    pre = df.drop(*[c for c in exclude if c in df.columns])
    groups = fit_one_hot(pre, target, strategy, keys, max_categories)
    encoded = apply_one_hot(pre, target, groups, keys)
    return encoded, {"groups": groups, "excluded": exclude, "pre_encode": pre,
                     "converted": converted, "strategy": strategy}


# ------------------------------------------------------------ feature schema
def _field(name: str, kind: str, **more) -> dict:
    return {"name": name, "type": kind, "categories": None, "drop_first": None, "dummy_columns": None} | more


def build_input_schema(pre_encode: DataFrame, groups: dict, features: Sequence[str],
                       excluded: Sequence[str] = (), keys: Sequence[str] = ()) -> list[dict]:
    """What a raw table must hold for the model's features (F4): the one-hot
    groups of which a dummy column is a feature, then the numeric features."""
    columns_of = {c: [d for d, _ in g["dummies"] if d in features] for c, g in groups.items()}
    encoded = [_field(c, "categorical", categories=list(groups[c]["categories"]),
                      drop_first=bool(groups[c]["drop_first"]), dummy_columns=found) for c, found in columns_of.items() if found]
    other = {*groups, *excluded, *keys}
    plain = [_field(c, "numeric") for c in pre_encode.columns
             if c in features and c not in other and is_numeric_type(pre_encode.schema[c].dataType)]
    if not encoded + plain:
        raise DataError("Feature schema is empty.")
    return encoded + plain


def schema_frame(spark, schema: list[dict]) -> DataFrame:
    rows = [(s["name"], s["type"], s.get("categories"), s.get("drop_first"), s.get("dummy_columns"))
            for s in schema]
    return spark.createDataFrame(rows, SCHEMA_DDL)


def schema_from_frame(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


# --------------------------------------------------------------- label index
def label_classes(df: DataFrame, target: str) -> list[str]:
    """Sorted distinct non-null labels as text (F5); too many raise."""
    return stats.label_values(df.select(col(target)))


def label_index(target_col, classes: Sequence[str]):
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    return m[target_col.cast("string")]


def label_inverse(index_col, classes: Sequence[str]):
    arr = F.array(*[F.lit(c) for c in classes])
    return F.element_at(arr, index_col.cast("int") + 1)


# ------------------------------------------------------------- raw transform
def raw_feature_exprs(raw: DataFrame, schema: list[dict], features: Sequence[str],
                      fill: dict[str, float] | None = None) -> list:
    """One expression per model feature, in feature order.

    Numeric: absent, NULL or '' -> 0.0 (or the fitted fill value); text that is
    not a number raises.  Categorical: trimmed lower-case match against each
    kept category; unknown or NULL -> all zeros.
    """
    fill = fill or {}
    exprs: dict[str, object] = {}
    present = set(raw.columns)
    for field in schema:
        name = field["name"]
        if field["type"] == "numeric":
            if name not in features:
                continue
            if name not in present:
                exprs[name] = F.lit(float(fill.get(name, 0.0)))
                continue
            dt = raw.schema[name].dataType
            if is_numeric_type(dt):
                v = col(name).cast("double")
                v = F.when(F.isnan(v), None).otherwise(v)
            else:
                txt = trim_all(col(name).cast("string"))
                parsed = parse_number(txt)
                bad = txt.isNotNull() & (txt != "") & parsed.isNull() & \
                    ~F.lower(txt).isin("nan", "+nan", "-nan")
                v = F.when(bad, F.raise_error(F.concat(F.lit(f"Non-numeric value for {name}: "), txt))) \
                    .otherwise(parsed)
            exprs[name] = F.coalesce(v, F.lit(float(fill.get(name, 0.0))))
        else:
            dummies = set(field.get("dummy_columns") or [])
            norm = F.lower(trim_all(col(name).cast("string"))) if name in present else None
            for cat in field["categories"]:
                d = f"{name}_{cat}"
                if d not in dummies:
                    continue
                if norm is None:
                    exprs[d] = F.lit(0.0)
                else:
                    exprs[d] = F.coalesce((norm == F.lit(str(cat).strip().lower())).cast("double"), F.lit(0.0))
    return [exprs.get(f, F.lit(0.0)).alias(f) for f in features]


def transform_raw(raw: DataFrame, schema: list[dict], features: Sequence[str],
                  passthrough: Sequence[str] = (), fill: dict[str, float] | None = None) -> DataFrame:
    """Raw table -> model-ready feature table (+ passthrough columns)."""
    return raw.select(*[col(c) for c in passthrough], *raw_feature_exprs(raw, schema, features, fill))

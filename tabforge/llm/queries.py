"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.collocations import collocations
from tabforge.llm.decontaminate import decontaminate
from tabforge.llm.langid import held_out, identify, train
from tabforge.llm.linededup import dedup_lines
from tabforge.llm.mtree import top_products
from tabforge.llm.outliers import judge_quality
from tabforge.llm.packing import pack_documents
from tabforge.llm.resampling import importance_sample
from tabforge.llm.runs import Words, find_runs, run_digests
from tabforge.llm.secrets import scan_secrets
from tabforge.llm.sharding import hilbert_shards
from tabforge.llm.sigtree import jaccard_components
from tabforge.llm.tokenfile import read_token_files, write_token_files
from tabforge.session import work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, as read back from the plane-shuffled files it was written to."""
    path = work_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, end_id=1)
    return read_token_files(spark, path)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document, and whether the sample of good text has it."""
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and robust-distance verdict of every document."""
    return judge_quality(table(spark, sf_dir, "documents")).drop("distance", "n_upper")


def op5_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component: 5-word shingles, similarity 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("text_hash", "component")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 8 shards along the Hilbert curve."""
    return hilbert_shards(table(spark, sf_dir, "documents"), shards=8)


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document, whole texts against all items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by trees trained on the other three quarters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeated windows cover."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "text")


def op11_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors, by integer inner product, of every twentieth id."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 strongest phrases of two or three words."""
    return collocations(table(spark, sf_dir, "documents"))


def echo_tail(doc_id: int | None, words: Words) -> Words:
    """A tenth of the documents, by the checksum of the id, get a periodic tail."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, strongest and digests of every document's periodic runs of words."""
    return run_digests(find_runs(table(spark, sf_dir, "documents"), echo_tail))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 4], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS p FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, e2.y FROM reach JOIN e2 ON e2.x = reach.y),
m AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM bi)),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bi))),
hits AS (SELECT r, p, n, item_id FROM dw JOIN bw USING (n, g)),
nh AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
ni AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""

OP10_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, text, lines, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^\x20\x09-\x0D]')) AS kept FROM l),
n AS (SELECT *, list_transform(kept, lambda i: lines[i]) AS body, CAST(len(kept) AS BIGINT) AS n_lines FROM k),
w AS (SELECT doc_id, n_lines, p, least(n_lines - p, 3) AS size, array_to_string(body[p + 1:p + 3], chr(10)) AS g
      FROM (SELECT *, unnest(range(0, greatest(n_lines - 2, least(n_lines, 1)))) AS p FROM n)),
o AS (SELECT *, row_number() OVER (PARTITION BY size, g ORDER BY doc_id, p) AS nth FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS i FROM o WHERE nth > 1),
gone AS (SELECT doc_id, list(i ORDER BY i) AS removed FROM c GROUP BY doc_id)
SELECT doc_id, n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(removed, ','), '') AS removed,
       CASE WHEN removed IS NULL THEN text WHEN len(removed) = n_lines THEN ''
            ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1),
                 lambda j: NOT list_contains(list_transform(removed, lambda i: kept[i + 1]), j)), lambda j: lines[j]), chr(10)) END AS text
FROM n LEFT JOIN gone USING (doc_id)
"""

OP11_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
"""

OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS s))),
c AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY lang, s, phrase HAVING count(*) >= 10),
k AS (SELECT lang, s, phrase, f AS a, unnest(range(1, s)) AS k, string_split(phrase, ' ') AS w FROM c WHERE s > 1),
x AS (SELECT k.lang, k.s, k.phrase, a, k, h.f AS l, t.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(h.f AS HUGEINT) * t.f) AS score
      FROM k JOIN c h ON h.lang = k.lang AND h.phrase = array_to_string(w[1:k], ' ') JOIN c t ON t.lang = k.lang AND t.phrase = array_to_string(w[k + 1:], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(f) AS longer FROM (
      SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM (SELECT lang, string_split(phrase, ' ') AS w, f FROM c WHERE s = 3)
      UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM (SELECT lang, string_split(phrase, ' ') AS w, f FROM c WHERE s = 3)) GROUP BY lang, phrase),
z AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, encode(m.phrase)) AS rank
      FROM m LEFT JOIN o ON o.lang = m.lang AND o.phrase = m.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM z JOIN n USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_token_files, op3_importance_resampling, op4_robust_outliers, op5_signature_tree_join, op6_secret_scan, op7_hilbert_shards,
                              op8_winnowing_decontamination, op9_language_id, op10_line_dedup, op11_mtree_search, op12_phrase_collocations, op13_periodic_runs)
}
ORACLE_SQL: dict[str, str] = {"op5_signature_tree_join": OP5_SQL, "op8_winnowing_decontamination": OP8_SQL, "op10_line_dedup": OP10_SQL, "op11_mtree_search": OP11_SQL, "op12_phrase_collocations": OP12_SQL}

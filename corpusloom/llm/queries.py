"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import kept_text

    return kept_text(_read(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crosspolytope import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op4_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .anchordedup import kept_words

    return kept_words(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op8_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), 24)


def op9_id_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idmatrix import write_and_digest

    return write_and_digest(_read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_suffix_dedup, op3_nearest_neighbours, op4_anchor_dedup, op5_decontamination, op6_jaccard_join, op7_mixture_packing, op8_minimax_sharding, op9_id_matrix, op10_toxicity)}

#: DuckDB SQL for the rows of a query, where SQL can express it.
ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
             f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
        SELECT page_id, payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             b AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d),
             w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x, CASE WHEN 2 * i + 200 <= len(h) THEN md5(substr(h, 2 * i + 1, 200)) END AS g FROM b),
             f AS (SELECT doc_id, i, x, (g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1)::INT AS again FROM w),
             r AS (SELECT doc_id, i, x, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
             e AS (SELECT *, (gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0)::INT AS begins FROM r),
             a AS (SELECT doc_id, count(*) AS n, sum(gone)::BIGINT AS gone, sum(begins)::BIGINT AS spans, string_agg(x, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN a USING (doc_id)""",
    "op4_anchor_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             b AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
             s AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS g FROM b),
             f AS (SELECT doc_id, i, x, (g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1)::INT AS again FROM s),
             r AS (SELECT doc_id, i, x, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
             a AS (SELECT doc_id, sum(gone)::BIGINT AS gone, string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)""",
    "op5_decontamination": r"""
        WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
             d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT item_id, least(5, len(w)) AS m, unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
             n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
             h AS (SELECT DISTINCT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS g FROM d, (SELECT DISTINCT m FROM s) WHERE len(w) >= m),
             c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM h JOIN s USING (m, g) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, n AS n_item_shingles, n_shared FROM c JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n""",
    "op6_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda k: array_to_string(w[k:k + 4], ' '))) AS g FROM d WHERE len(w) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.doc_id),
             c AS (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
}

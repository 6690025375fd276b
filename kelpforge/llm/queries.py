"""Registered queries of the operators and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm import centroids, decontaminate, exact_dedup, language_id, packing, periodic_runs, quality, secret_scan, simhash, token_counts, toxicity, url_filter, warc
from kelpforge.llm._common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(spark, read_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(secret_scan.BASE_RULES))
    return found.select(
        "doc_id",
        *(count(r.kind) for r in secret_scan.BASE_RULES),
        F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where the driver finds the vocabulary's file; executors need none

    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_runs(read_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality": op6_quality,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroids": op13_centroids,
}


def _secret_sql() -> str:
    rules = secret_scan.BASE_RULES + secret_scan.ADDED_RULES
    parts = []
    for rank, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, m[i] AS hit,
               CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM (SELECT doc_id, m, p, g, unnest(range(1, len(m) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS p FROM d))
        WHERE length(g[i]) >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    told = "string_agg(kind || ':' || start || ':' || (start + length(hit)), ',' ORDER BY start, rank)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)}),
    a AS (SELECT doc_id, {counts}, {told} FILTER (WHERE rank < {len(secret_scan.BASE_RULES)}) AS base, {told} AS every FROM s GROUP BY doc_id)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE_RULES)},
           sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
    FROM d LEFT JOIN a USING (doc_id)"""


_EXACT_SQL = r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
    FROM (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)"""

_URL_SQL = r"""
    WITH rules(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
    u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    fits AS (SELECT u.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
             FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.page_id)
    SELECT u.page_id, u.host, u.path, f.rule,
           coalesce(f.verdict, CASE WHEN regexp_matches(u.host, '^(.*\.)?spam[^./]*\.') OR regexp_matches(u.host, '^(.*\.)?adserver\.') THEN 'block' ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN fits f USING (page_id)"""

_WARC_SQL = """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, TRUE AS intact
    FROM f"""



def _centroid_sql() -> str:
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    ctes = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
             WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, x FROM v ORDER BY k LIMIT 16)",
    ]
    for n in range(centroids.ROUNDS + 1):
        ctes.append(f"a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(k, d * 100 + k) AS k, min(d) AS d FROM (SELECT v.r, v.vec_id, v.x, c.k, {distance} AS d FROM v, c{n} c) GROUP BY r)")
        if n < centroids.ROUNDS:
            ctes.append(f"""m{n} AS MATERIALIZED (SELECT k, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x
                FROM (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT k, unnest(x) AS y, unnest(range(64)) AS i FROM a{n}) GROUP BY k, i) GROUP BY k)""")
            ctes.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (k))")
    last = centroids.ROUNDS
    return f"""
    WITH {", ".join(ctes)}
    SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
           CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{last} a JOIN c{last} c USING (k)"""


ORACLE_SQL: dict[str, str] = {
    "op2_warc": _WARC_SQL,
    "op5_secret_scan": _secret_sql(),
    "op8_exact_dedup": _EXACT_SQL,
    "op9_url_filter": _URL_SQL,
    "op13_centroids": _centroid_sql(),
}

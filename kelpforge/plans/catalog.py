"""Registered queries over the driver's tables, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.functions import hashing, numeric, text
from kelpforge.operators import features, governance, ledger, planning, privacy, ranking, retrieval, sentiment, statistics, tables
from kelpforge.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# Adverse impact

_OUTCOMES = "SELECT l_returnflag AS grp, count(*) AS total, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS selected FROM lineitem GROUP BY 1"


def _line_outcomes(spark, sf_dir):
    return statistics.selection_outcomes(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_linestatus") == "F")


@query(_OUTCOMES)
def selection_outcomes(spark, sf_dir):
    return _line_outcomes(spark, sf_dir)


_FOUR = """WITH o AS ({outcomes}), e AS (SELECT *, selected / total AS rate, total >= 30 AS eligible FROM o),
m AS (SELECT *, max(CASE WHEN eligible THEN rate END) OVER () AS best, sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER () AS parties FROM e),
r AS (SELECT *, CASE WHEN parties >= 2 AND best > 0 AND eligible THEN rate / best END AS ratio FROM m)
SELECT grp, total, selected, round(rate, 6) AS rate, eligible, round(ratio, 6) AS ratio, coalesce(ratio < 0.8, FALSE) AS impacted,
CASE WHEN NOT coalesce(parties >= 2 AND best > 0, FALSE) THEN 'INSUFFICIENT_DATA' WHEN bool_or(coalesce(ratio < 0.8, FALSE)) OVER () THEN 'ADVERSE_IMPACT' ELSE 'NO_ADVERSE_IMPACT' END AS verdict FROM r"""


@query(_FOUR.format(outcomes=_OUTCOMES))
def four_fifths(spark, sf_dir):
    return statistics.four_fifths(_line_outcomes(spark, sf_dir)).withColumn("rate", r6("rate")).withColumn("ratio", r6("ratio"))


@query(_FOUR.format(outcomes="SELECT n_name AS grp, count(*) AS total, CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS selected FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"))
def adverse_impact_by_nation(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    report = statistics.four_fifths(statistics.selection_outcomes(joined, "n_name", F.col("c_acctbal") > 5000))
    return report.withColumn("rate", r6("rate")).withColumn("ratio", r6("ratio"))


@query(f"""WITH o AS ({_OUTCOMES}), s AS (SELECT sum(total) AS n, sum(selected) AS k, count(*) AS g FROM o),
t AS (SELECT sum(pow(selected - total * k / n, 2) / (total * k / n) + pow(selected - total * k / n, 2) / (total * (n - k) / n)) AS x, max(g) - 1 AS dof FROM o, s)
SELECT round(x, 6) AS statistic, CAST(dof AS BIGINT) AS dof, round(exp(-x / 2), 6) AS p_value FROM t""")
def independence_three_groups(spark, sf_dir):
    return statistics.independence_test(_line_outcomes(spark, sf_dir)).select(r6("statistic").alias("statistic"), F.col("dof").cast("long").alias("dof"), r6("p_value").alias("p_value"))


@query()
def rescreened_without_column(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rule = lambda df: F.coalesce(F.col("p_size"), F.lit(25)) * 20 + F.col("p_retailprice") / 10 > 600
    return statistics.rescreened(parts, "p_brand", rule, "p_size")


# Counting, searching, paging


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def group_counts(spark, sf_dir):
    return tables.group_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT count(DISTINCT o_custkey) AS total, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS f, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_custkey END) AS o, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS p FROM orders")
def distinct_entities_by_status(spark, sf_dir):
    return tables.distinct_by_status(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("""SELECT 'orders' AS name, count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS marked FROM orders
UNION ALL SELECT 'events', count(*), count(CASE WHEN event_type = 'purchase' THEN 1 END) FROM events
UNION ALL SELECT 'customers', count(*), count(CASE WHEN c_acctbal < 0 THEN 1 END) FROM customer""")
def overview_counts(spark, sf_dir):
    parts = [("orders", "orders", F.col("o_orderstatus") == "F"), ("events", "events", F.col("event_type") == "purchase"), ("customers", "customer", F.col("c_acctbal") < 0)]
    told = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(c, 1)).alias("marked")).select(F.lit(n).alias("name"), "total", "marked") for n, t, c in parts]
    return told[0].union(told[1]).union(told[2])


@query("SELECT o_custkey, max(o_orderkey) + 1 AS next_version FROM orders GROUP BY 1")
def next_versions(spark, sf_dir):
    return tables.next_version(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def search_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return tables.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 25, 50)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 40")
def keyset_page(spark, sf_dir):
    return tables.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 40)


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def substring_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(tables.contains_any(["p_name", "p_brand", "p_type"], "%RING_")).select("p_partkey", "p_name")


@query("SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def time_range(spark, sf_dir):
    import datetime as dt

    return tables.between(table(spark, sf_dir, "events"), "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6, 12)).select("event_id", "ts")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tables.having_status(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", F.col("o_orderstatus") == "P")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def anti_join_seen(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 48").withColumnRenamed("l_partkey", "p_partkey")
    return retrieval.exclude(table(spark, sf_dir, "part").select("p_partkey"), seen, "p_partkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def latest_per_key(spark, sf_dir):
    return tables.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def insert_or_ignore(spark, sf_dir):
    return tables.insert_or_ignore(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def newest_events_per_user(spark, sf_dir):
    return tables.newest_per_group(table(spark, sf_dir, "events"), "user_id", 10, "ts", "event_id").select("user_id", "event_id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) WHERE k % 7 = 0 AND k < 7 * 50")
def systematic_sample(spark, sf_dir):
    return tables.systematic_sample(table(spark, sf_dir, "events"), 7, 50, "event_type", "event_id").select("event_type", "event_id")


@query("SELECT event_id, user_id, in_window FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 2")
def rate_limit_violations(spark, sf_dir):
    return tables.rate_violations(table(spark, sf_dir, "events"), ["user_id"], "ts", 2, 7200).select("event_id", "user_id", "in_window")


@query("""WITH s AS (SELECT user_id, event_id, ts AS a, ts + INTERVAL 45 MINUTE AS b FROM events)
SELECT x.user_id, x.event_id AS first_id, y.event_id AS second_id FROM s x JOIN s y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a < y.b AND y.a < x.b""")
def interval_overlap(spark, sf_dir):
    slots = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").alias("a"), F.expr("ts + INTERVAL 45 MINUTES").alias("b"))
    pairs = tables.overlapping(slots, slots, "user_id", "a", "b").where("a.event_id < b.event_id")
    return pairs.select(F.col("a.user_id").alias("user_id"), F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("second_id"))


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS epoch FROM events)
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch ORDER BY event_id) AS k FROM e WHERE event_type = 'error') WHERE k = 1""")
def alert_deduplication(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    alerts = rows.select("event_id", F.col("user_id").alias("dedupe_key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "clear").otherwise("raise").alias("kind"))
    return tables.unsuppressed_alerts(alerts).select("event_id")


# Point in time

_VIEW = features.FeatureView("activity", [features.Feature("view", 0.0), features.Feature("click", 1.0)], ttl_seconds=3 * 86_400)


def _writes(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')")
    return e.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("event_time"), F.col("event_id").alias("write_seq"), F.create_map("event_type", "value").alias("values"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("label_time"), "event_id")


def _pit_sql(embargo: int) -> str:
    one = lambda f, d: f"""coalesce((SELECT arg_max(value, ts) FROM events f WHERE f.user_id = l.user_id AND f.event_type = '{f}'
        AND f.ts <= l.ts - INTERVAL {embargo} SECOND AND f.ts >= l.ts - INTERVAL {embargo} SECOND - INTERVAL 3 DAY), {d}) AS "{f}" """  # noqa: E731
    return f"""SELECT l.user_id AS entity_id, l.event_id, {one('view', 0.0)}, {one('click', 1.0)} FROM events l WHERE l.event_type = 'purchase'"""


@query(_pit_sql(0))
def point_in_time(spark, sf_dir):
    return features.point_in_time_join(_VIEW, _labels(spark, sf_dir), _writes(spark, sf_dir)).select("entity_id", "event_id", "view", "click")


@query(_pit_sql(7200))
def point_in_time_embargo(spark, sf_dir):
    return features.point_in_time_join(_VIEW, _labels(spark, sf_dir), _writes(spark, sf_dir), 7200).select("entity_id", "event_id", "view", "click")


@query("""SELECT user_id AS entity_id, coalesce(arg_max(value, ts) FILTER (WHERE event_type = 'view'), 0.0) AS "view", coalesce(arg_max(value, ts) FILTER (WHERE event_type = 'click'), 1.0) AS click
FROM events WHERE event_type IN ('view', 'click') GROUP BY 1""")
def latest_features(spark, sf_dir):
    return features.latest(_VIEW, _writes(spark, sf_dir))


@query("""SELECT user_id AS entity_id, coalesce(arg_max(value, ts) FILTER (WHERE event_type = 'view'), 0.0) AS "view", coalesce(arg_max(value, ts) FILTER (WHERE event_type = 'click'), 1.0) AS click
FROM events WHERE event_type IN ('view', 'click') AND ts <= TIMESTAMP '2024-01-15 00:00:00' AND ts >= TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1""")
def latest_features_as_of(spark, sf_dir):
    return features.latest(_VIEW, _writes(spark, sf_dir), "2024-01-15 00:00:00")


@query("""WITH x AS (SELECT l.user_id, l.ts, (SELECT f.value FROM events f WHERE f.user_id = l.user_id AND f.event_type = 'view' AND f.ts > l.ts ORDER BY f.ts LIMIT 1) AS v FROM events l WHERE l.event_type = 'purchase')
SELECT user_id AS entity_id, ts AS label_time, 'view' AS feature, v AS value FROM x WHERE v IS NOT NULL AND v <> 0.0
AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = x.user_id AND f.event_type = 'view' AND f.value = x.v AND f.ts <= x.ts)""")
def leakage_audit(spark, sf_dir):
    following = Window.partitionBy("user_id").orderBy("ts").rowsBetween(1, Window.unboundedFollowing)
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'purchase')")
    leaky = e.withColumn("view", F.first(F.when(F.col("event_type") == "view", F.col("value")), ignorenulls=True).over(following)).where("event_type = 'purchase' AND view IS NOT NULL")
    examples = leaky.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("label_time"), "view", F.lit(1.0).alias("click"))
    return features.leaked(_VIEW, examples, _writes(spark, sf_dir))


_ROW_TEXT = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("event_id", "user_id", "event_type", "value"))
_ROW_SUMS = " || ':' || ".join(f"sum(CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT))" for k in range(8))


@query(f"SELECT count(*) AS rows, sha256(count(*) || ':' || {_ROW_SUMS}) AS fingerprint FROM (SELECT sha256({_ROW_TEXT}) AS h FROM events)")
def table_fingerprint(spark, sf_dir):
    return features.data_fingerprint(table(spark, sf_dir, "events"), "event_id", "user_id", "event_type", "value")


# Drift


def _drift_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), "value", (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("is_live"))


_DRIFT_CTE = "v AS (SELECT event_type AS feature, value, ts >= TIMESTAMP '2024-01-16 00:00:00' AS is_live FROM events)"
_PSI_NUMERIC = f"""WITH {_DRIFT_CTE},
q AS (SELECT feature, list_distinct([quantile_cont(value, 0.1), quantile_cont(value, 0.2), quantile_cont(value, 0.3), quantile_cont(value, 0.4), quantile_cont(value, 0.5), quantile_cont(value, 0.6), quantile_cont(value, 0.7), quantile_cont(value, 0.8), quantile_cont(value, 0.9)]) AS edges FROM v WHERE NOT is_live GROUP BY 1),
b AS (SELECT v.feature, len(list_filter(q.edges, lambda e: e <= v.value)) AS bin, count(*) FILTER (WHERE NOT is_live) AS nr, count(*) FILTER (WHERE is_live) AS nl FROM v JOIN q USING (feature) GROUP BY 1, 2),
s AS (SELECT feature, bin, greatest(1e-6, nr / sum(nr) OVER (PARTITION BY feature)) AS r, greatest(1e-6, nl / sum(nl) OVER (PARTITION BY feature)) AS l FROM b)"""
_BANDS = "CASE WHEN {x} >= 0.25 THEN '{c}' WHEN {x} >= 0.1 THEN '{b}' ELSE '{a}' END"


@query(f"{_PSI_NUMERIC} SELECT feature, round(sum((l - r) * ln(l / r)), 6) AS psi, {_BANDS.format(x='sum((l - r) * ln(l / r))', a='stable', b='warn', c='alert')} AS severity FROM s GROUP BY 1")
def psi_numeric_edges_first(spark, sf_dir):
    return statistics.psi_edges_first(_drift_values(spark, sf_dir)).withColumn("psi", r6("psi"))


@query(f"{_PSI_NUMERIC} SELECT feature, CAST(bin AS INT) AS bin, round(r, 6) AS reference, round(l, 6) AS live, round((l - r) * ln(l / r), 6) AS contribution, round(sum((l - r) * ln(l / r)) OVER (PARTITION BY feature), 6) AS psi, {_BANDS.format(x='sum((l - r) * ln(l / r)) OVER (PARTITION BY feature)', a='STABLE', b='MODERATE', c='SIGNIFICANT')} AS severity FROM s")
def psi_numeric_merge_first(spark, sf_dir):
    out = statistics.psi_merge_first(_drift_values(spark, sf_dir))
    return out.select("feature", "bin", *(r6(c).alias(c) for c in ("reference", "live", "contribution", "psi")), "severity")


_SIZES = "SELECT l_returnflag AS feature, CAST(l_linenumber AS DOUBLE) AS value, l_linestatus = 'F' AS is_live FROM lineitem"


@query(f"""WITH v AS ({_SIZES}), b AS (SELECT feature, value, count(*) FILTER (WHERE NOT is_live) AS nr, count(*) FILTER (WHERE is_live) AS nl FROM v GROUP BY 1, 2),
s AS (SELECT feature, greatest(1e-6, nr / sum(nr) OVER (PARTITION BY feature)) AS r, greatest(1e-6, nl / sum(nl) OVER (PARTITION BY feature)) AS l FROM b)
SELECT feature, round(sum((l - r) * ln(l / r)), 6) AS psi, 'stable' AS severity FROM s GROUP BY 1""")
def psi_discrete(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("feature"), F.col("l_linenumber").cast("double").alias("value"), (F.col("l_linestatus") == "F").alias("is_live"))
    return statistics.psi_edges_first(v).withColumn("psi", r6("psi"))


@query(f"""WITH v AS (SELECT 'priority' AS feature, o_orderpriority AS category, o_orderstatus = 'F' AS is_live FROM orders),
b AS (SELECT feature, category, count(*) FILTER (WHERE NOT is_live) AS nr, count(*) FILTER (WHERE is_live) AS nl FROM v GROUP BY 1, 2),
s AS (SELECT feature, category, greatest(1e-6, nr / sum(nr) OVER ()) AS r, greatest(1e-6, nl / sum(nl) OVER ()) AS l FROM b)
SELECT feature, category, round(r, 6) AS reference, round(l, 6) AS live, round((l - r) * ln(l / r), 6) AS contribution, round(sum((l - r) * ln(l / r)) OVER (), 6) AS psi, {_BANDS.format(x='sum((l - r) * ln(l / r)) OVER ()', a='STABLE', b='MODERATE', c='SIGNIFICANT')} AS severity FROM s""")
def psi_categorical(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select(F.lit("priority").alias("feature"), F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("is_live"))
    return statistics.psi_categorical(v).select("feature", "category", *(r6(c).alias(c) for c in ("reference", "live", "contribution", "psi")), "severity")


@query(f"""WITH {_DRIFT_CTE}, c AS (SELECT feature, value, count(*) FILTER (WHERE NOT is_live) AS a, count(*) FILTER (WHERE is_live) AS b FROM v GROUP BY 1, 2),
g AS (SELECT feature, sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p AS gap FROM c WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature))
SELECT feature, round(max(abs(gap)), 6) AS statistic FROM g GROUP BY 1""")
def ks_statistic(spark, sf_dir):
    return statistics.ks_test(_drift_values(spark, sf_dir)).select("feature", r6("statistic").alias("statistic"))


@query()
def drift_verdicts(spark, sf_dir):
    return statistics.drift_verdict(_drift_values(spark, sf_dir))


@query()
def drift_requests(spark, sf_dir):
    cat = table(spark, sf_dir, "orders").select(F.lit("priority").alias("feature"), F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") == "F").alias("is_live"))
    return statistics.drift_requests(_drift_values(spark, sf_dir), cat, {"click": "psi", "view": "ks", "priority": "categorical"})


# Metrics

_P = "(value / 500.0)"


@query(f"""WITH x AS (SELECT event_type, {_P} AS p, CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS y FROM events), b AS (SELECT event_type, {' + '.join(f'CAST(p > {k / 10} AS INT)' for k in range(1, 10))} AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM x GROUP BY 1, 2)
SELECT event_type, round(sum(n * abs(p - y)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS "rows" FROM b GROUP BY 1""")
def expected_calibration_error(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 500.0).alias("p"), F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(0.0).alias("y"))
    return statistics.calibration_error(x, "p", "y", by=["event_type"]).withColumn("ece", r6("ece"))


@query("""WITH s AS (SELECT event_type, value AS s, count(*) FILTER (WHERE user_id % 3 = 0) AS p, count(*) FILTER (WHERE user_id % 3 <> 0) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT event_type, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM r GROUP BY 1""")
def roc_auc(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return statistics.roc_auc(x, "value", "y", ["event_type"]).withColumn("auc", r6("auc"))


def _lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") % 4).alias("rel"))
    return ranking.ranked(e, "user_id", "value", "event_id")


_LIST_CTE = "l AS (SELECT user_id, event_id, value, event_id % 4 AS rel, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)"


@query(f"""WITH {_LIST_CTE}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rel DESC) AS best FROM l),
g AS (SELECT user_id, sum(CASE WHEN rank <= 10 THEN (pow(2, rel) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 10 THEN (pow(2, rel) - 1) / log2(best + 1) ELSE 0 END) AS idcg FROM i GROUP BY 1)
SELECT user_id, round(dcg, 6) AS dcg, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM g""")
def ndcg_at_10(spark, sf_dir):
    return ranking.ndcg(_lists(spark, sf_dir), "user_id", "rank", "rel", 10).select("user_id", r6("dcg").alias("dcg"), r6("ndcg").alias("ndcg"))


@query(f"""WITH {_LIST_CTE}, w AS (SELECT user_id, count(*) AS wanted FROM l WHERE rel = 3 GROUP BY 1), h AS (SELECT user_id, count(*) AS hits FROM l WHERE rank <= 10 AND rel = 3 GROUP BY 1), u AS (SELECT DISTINCT user_id FROM l)
SELECT u.user_id, round(CASE WHEN wanted > 0 THEN coalesce(hits, 0) / wanted ELSE 0 END, 6) AS recall, round(coalesce(hits, 0) / 10, 6) AS precision FROM u LEFT JOIN w USING (user_id) LEFT JOIN h USING (user_id)""")
def recall_precision_at_10(spark, sf_dir):
    rows = _lists(spark, sf_dir)
    return ranking.recall_precision(rows, rows.where("rel = 3"), "user_id", "event_id", "rank", 10).select("user_id", r6("recall").alias("recall"), r6("precision").alias("precision"))


@query(f"""WITH {_LIST_CTE}, h AS (SELECT *, CASE WHEN rel = 3 THEN sum(CASE WHEN rel = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rank) / rank END AS p FROM l)
SELECT user_id, round(coalesce(1 / min(CASE WHEN rel = 3 THEN rank END), 0), 6) AS rr, round(coalesce(sum(p) / count(CASE WHEN rel = 3 THEN 1 END), 0), 6) AS ap FROM h GROUP BY 1""")
def reciprocal_rank_and_ap(spark, sf_dir):
    rows = _lists(spark, sf_dir)
    return ranking.reciprocal_rank_and_ap(rows, rows.where("rel = 3"), "user_id", "event_id", "rank").select("user_id", r6("rr").alias("rr"), r6("ap").alias("ap"))


@query("SELECT user_id, round(1 - product(1 - value / 1000), 6) AS p_any FROM events WHERE event_type = 'view' GROUP BY 1")
def any_click_probability(spark, sf_dir):
    v = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", (F.col("value") / 1000).alias("p"))
    return ranking.any_click_probability(v, "user_id", "p").withColumn("p_any", r6("p_any"))


# Experiments

_BUCKET = "(CAST('0x' || substr(sha256('salt-a:feed:' || CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) / 18446744073709551616.0)"
_ARM = f"CASE WHEN {_BUCKET} < 0.1 THEN 'holdout' WHEN ({_BUCKET} - 0.1) / 0.9 < 0.5 THEN 'control' ELSE 'treatment' END"


def _assigned(spark, sf_dir):
    position = hashing.bucket(F.col("c_custkey").cast("string"), "feed", "salt-a")
    return table(spark, sf_dir, "customer").withColumn("variant", statistics.assign_variant(position, [("control", 1.0), ("treatment", 1.0)], 0.1))


@query(f"SELECT c_custkey, {_ARM} AS variant FROM customer")
def assign_variant(spark, sf_dir):
    return _assigned(spark, sf_dir).select("c_custkey", "variant")


@query(f"WITH a AS (SELECT {_ARM} AS variant, c_acctbal > 4000 AS s FROM customer) SELECT variant, count(*) AS trials, count(*) FILTER (WHERE s) AS successes FROM a WHERE variant <> 'holdout' GROUP BY 1")
def experiment_counts(spark, sf_dir):
    return statistics.arm_counts(_assigned(spark, sf_dir), "variant", F.col("c_acctbal") > 4000)


@query("""WITH c AS (SELECT event_type, count(*) FILTER (WHERE user_id % 2 = 0 AND value > 50) AS cs, count(*) FILTER (WHERE user_id % 2 = 0) AS ct, count(*) FILTER (WHERE user_id % 2 = 1 AND value > 45) AS ts, count(*) FILTER (WHERE user_id % 2 = 1) AS tt FROM events GROUP BY 1),
r AS (SELECT *, cs / ct AS rc, ts / tt AS rt, (cs + ts) / (ct + tt) AS p FROM c), s AS (SELECT *, p * (1 - p) AS v, ct * tt / (ct + tt) AS e FROM r),
x AS (SELECT *, CASE WHEN ct + tt >= 200 THEN sqrt(v / (v + e * 0.01)) * exp(least(e * e * 0.01 * pow(rt - rc, 2) / (2 * v * (v + e * 0.01)), 700)) ELSE 1 END AS lr FROM s)
SELECT event_type, round(rc, 6) AS control_rate, round(rt, 6) AS treatment_rate, round((rt - rc) / rc, 6) AS lift, round(lr, 4) AS likelihood_ratio,
CASE WHEN lr >= 20 AND rt > rc THEN 'TREATMENT_WINS' WHEN lr >= 20 THEN 'CONTROL_WINS' WHEN lr <= 0.05 THEN 'NO_DIFFERENCE' ELSE 'CONTINUE' END AS decision FROM x""")
def sequential_test(spark, sf_dir):
    e, odd = table(spark, sf_dir, "events"), F.col("user_id") % 2 == 1
    n = lambda c: F.count(F.when(c, 1))
    counts = e.groupBy("event_type").agg(n(~odd & (F.col("value") > 50)).alias("control_successes"), n(~odd).alias("control_trials"), n(odd & (F.col("value") > 45)).alias("treatment_successes"), n(odd).alias("treatment_trials"))
    out = statistics.mixture_sprt(counts)
    return out.select("event_type", *(r6(c).alias(c) for c in ("control_rate", "treatment_rate", "lift")), F.round("likelihood_ratio", 4).alias("likelihood_ratio"), "decision")


@query("""WITH s AS (SELECT event_type AS arm, 1 + sum(CASE WHEN value > 50 THEN 1::DOUBLE ELSE 0 END) AS a, 1 + sum(CASE WHEN value > 50 THEN 0::DOUBLE ELSE 1 END) AS b FROM events GROUP BY 1)
SELECT arm, round(a, 6) AS successes, round(b, 6) AS failures, round(a / (a + b), 6) AS mean, round(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS sd FROM s""")
def bandit_posterior(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("reward", F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    return statistics.beta_posterior(e, "event_type", "reward").select("arm", *(r6(c).alias(c) for c in ("successes", "failures", "mean", "sd")))


@query("""WITH e AS (SELECT event_type, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS r, pow(0.99, count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY event_id)) AS w FROM events),
s AS (SELECT event_type AS arm, 1 + sum(r * w) AS a, 1 + sum((1 - r) * w) AS b FROM e GROUP BY 1)
SELECT arm, round(a, 6) AS successes, round(b, 6) AS failures, round(a / (a + b), 6) AS mean, round(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS sd FROM s""")
def bandit_decayed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("reward", F.when(F.col("value") > 50, 1.0).otherwise(0.0))
    return statistics.beta_posterior(e, "event_type", "reward", "event_id", 0.99).select("arm", *(r6(c).alias(c) for c in ("successes", "failures", "mean", "sd")))


def _windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("user_id") % 2 == 0, "live").otherwise("canary").alias("window"), "event_id", (F.col("event_type") == "click").alias("clicked"), (F.col("value") / 500).alias("probability"), F.col("value").alias("latency_ms"))
    return statistics.serving_window(rows, "window", ["event_id"], 2000, 1000)


@query("""WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'live' ELSE 'canary' END AS win, *, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id DESC) AS k FROM events), n AS (SELECT * FROM r WHERE k <= 2000),
t AS (SELECT win, value, row_number() OVER (PARTITION BY win ORDER BY value) AS i, count(*) OVER (PARTITION BY win) AS c FROM n WHERE k <= 1000),
p AS (SELECT win, value AS p95 FROM t WHERE i - 1 = least(c - 1, floor(c * 0.95)))
SELECT n.win AS "window", count(*) AS impressions, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS ctr, round(abs(avg(value / 500) - avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END)), 6) AS calibration_error, max(p95) AS p95_latency_ms FROM n JOIN p ON n.win = p.win GROUP BY 1""")
def serving_windows(spark, sf_dir):
    return _windows(spark, sf_dir).withColumn("ctr", r6("ctr")).withColumn("calibration_error", r6("calibration_error"))


@query("""WITH r AS (SELECT user_id % 2 = 0 AS live, *, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id DESC) AS k FROM events), n AS (SELECT *, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS y FROM r WHERE k <= 2000),
t AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS c FROM n WHERE k <= 1000 AND NOT live), p AS (SELECT value AS p95 FROM t WHERE i - 1 = least(c - 1, floor(c * 0.95))),
w AS (SELECT count(*) FILTER (WHERE NOT live) AS n, avg(y) FILTER (WHERE NOT live) / avg(y) FILTER (WHERE live) AS ratio, abs(avg(value / 500) FILTER (WHERE NOT live) - avg(y) FILTER (WHERE NOT live)) AS error FROM n),
j AS (SELECT *, list_filter([CASE WHEN ratio < 0.85 THEN printf('click-through ratio %.2f is below 0.85', ratio) END, CASE WHEN error > 0.15 THEN printf('calibration error %.3f is above 0.150', error) END,
CASE WHEN p95 > 250 THEN printf('p95 latency %.0f ms is above 250 ms', p95) END], lambda x: x IS NOT NULL) AS why FROM w, p)
SELECT n < 300 OR len(why) = 0 AS healthy, CASE WHEN n < 300 THEN 'too few impressions to judge' ELSE array_to_string(why, '; ') END AS reasons, round(ratio, 6) AS ctr_ratio, round(error, 6) AS calibration_error, round(p95, 6) AS p95_latency_ms FROM j""")
def rollout_verdict(spark, sf_dir):
    told = statistics.rollout_verdict(_windows(spark, sf_dir), "live", "canary")
    return told.select("healthy", F.array_join("reasons", "; ").alias("reasons"), *(r6(c).alias(c) for c in ("ctr_ratio", "calibration_error", "p95_latency_ms")))


# Ranking and retrieval


@query("""SELECT o_orderkey, round(0.7 * o_totalprice + 0.3 * o_totalprice * CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' THEN 1.0 ELSE pow(0.5, (epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(o_orderdate)) / 31536000.0) END, 2) AS fresh_score FROM orders""")
def freshness(spark, sf_dir):
    rows = ranking.apply_freshness(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", F.lit("1999-01-01 00:00:00"), 31_536_000.0, 0.3)
    return rows.select("o_orderkey", F.round("fresh_score", 2).alias("fresh_score"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 3")
def cap_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return ranking.cap_per_attribute(docs, "lang", "source", [F.desc("n_chars"), F.col("doc_id")], 3).select("doc_id", "source")


_VECTORS = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e)"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.where("id % 20 = 0"), e


@query(f"""WITH {_VECTORS}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 12) AS s FROM u a, u b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM p) SELECT query_id, item_id, round(s, 6) AS similarity, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10""")
def knn_exact(spark, sf_dir):
    return retrieval.exact_neighbours(*_vectors(spark, sf_dir), 10).withColumn("similarity", r6("similarity"))


@query()
def knn_cells_recall(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    return retrieval.recall_against(retrieval.cell_neighbours(queries, corpus, 10, 16, 10), retrieval.exact_neighbours(queries, corpus, 10))


@query(f"""WITH {_VECTORS}, m AS (SELECT *, label || ':' || (vec_id // 200) AS page FROM u), p AS (SELECT a.page, avg(1 - list_dot_product(a.v, b.v)) AS d FROM m a JOIN m b ON a.page = b.page AND a.vec_id < b.vec_id GROUP BY 1)
SELECT l.page, round(coalesce(d, 0), 6) AS diversity FROM (SELECT DISTINCT page FROM m) l LEFT JOIN p USING (page)""")
def list_diversity(spark, sf_dir):
    """A list is a served page: the vectors of a label are dealt into pages by blocks of 200 ids."""
    m = table(spark, sf_dir, "embeddings").withColumn("page", F.expr("concat(label, ':', vec_id div 200)"))
    return ranking.intra_list_diversity(m, "page", "vec_id", "embedding").withColumn("diversity", r6("diversity"))


@query()
def diversity_rerank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = retrieval.exact_neighbours(*_vectors(spark, sf_dir), 40)
    pool = near.join(e, near.item_id == e.vec_id).select(F.col("query_id").alias("request_id"), "item_id", F.col("similarity").alias("score"), F.col("label").cast("string").alias("topic"), F.col("embedding").alias("vector"))
    return ranking.rerank(pool, 15, 0.7, 0.1)


_BASKETS = "b AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _baskets(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), F.col("o_orderdate").alias("t"), F.col("l_quantity").alias("q"))


@query(f"""WITH {_BASKETS}, n AS (SELECT i, count(*) AS n FROM b GROUP BY 1), c AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM b x JOIN b y ON x.u = y.u AND x.i <> y.i GROUP BY 1, 2),
w AS (SELECT a, b, c, CAST(c AS DOUBLE) * c / CAST(p.n * q.n AS DOUBLE) AS w FROM c JOIN n p ON p.i = a JOIN n q ON q.i = b), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS rank FROM w)
SELECT a AS item_a, b AS item_b, c AS shared, round(sqrt(w), 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def item_knn(spark, sf_dir):
    """The twenty likest parts of every part, by the customers that bought both."""
    return retrieval.item_neighbours(_baskets(spark, sf_dir), "u", "i", 20).withColumn("similarity", r6("similarity"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1")
def popularity(spark, sf_dir):
    return ranking.popularity(table(spark, sf_dir, "lineitem"), "l_partkey")


_RATINGS = "r AS (SELECT o_custkey AS u, l_partkey AS i, l_quantity / 10 AS q, o_orderdate AS t, l_orderkey * 10 + l_linenumber AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"""WITH {_RATINGS}, k AS (SELECT u, i, s, count(*) OVER (PARTITION BY u) AS n, row_number() OVER (PARTITION BY u ORDER BY s DESC, i DESC) AS k FROM r WHERE q >= 4 QUALIFY n >= 5),
p AS (SELECT u, i, s, CASE k WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS part FROM k) SELECT u, i, s, part FROM p WHERE part = 'train' OR i IN (SELECT i FROM p WHERE part = 'train')""")
def leave_last_out(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = joined.select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), (F.col("l_quantity") / 10).alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("s"))
    return ranking.leave_last_out(rows, "u", "i", "q", "s")


# Text, privacy, skills


@query("""SELECT c_custkey, 'subj_' || substr(sha256('sixteen-byte-salt:id:' || CAST(c_custkey AS VARCHAR)), 1, 16) AS subject_key, 'inst_' || substr(sha256('sixteen-byte-salt:pedigree:' || lower(trim(c_mktsegment))), 1, 8) AS school,
round(2024 - (year(d) + (month(d) - 1) / 12), 2) AS joined_years_ago FROM (SELECT *, DATE '1990-01-01' + CAST(c_custkey % 4000 AS INT) AS d FROM customer)""")
def anonymised_people(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("school"), F.lit("x").alias("gender"),
        F.expr("date_add(DATE'1990-01-01', CAST(c_custkey % 4000 AS INT))").alias("joined_date"),
    )
    clean, _ = privacy.anonymise(people, privacy.Policy("sixteen-byte-salt", 2024))
    privacy.assert_clean(clean.columns, privacy.Policy("sixteen-byte-salt", 2024))
    return clean.select("c_custkey", "subject_key", "school", "joined_years_ago")


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{text.EMAIL}', '[email]', 'g'), '{text.PHONE}', '[phone]', 'g')) AS scrubbed FROM documents")
def scrubbed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.scrub(F.col("text")), 256).alias("scrubbed"))


_WORDS = sentiment.Lexicon(("the", "of"), ("on", "in"), ("or", "not"), (("who", ("he", "her")), ("where", ("at", "from"))))


def _polar_sql() -> str:
    named = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    cases = " ".join(f"WHEN list_has_any(near, {named(t)}) THEN '{n}'" for n, t in _WORDS.aspects)
    return f"""w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[a-z'']+') AS t FROM documents),
    x AS (SELECT doc_id, source, t, unnest(range(1, len(t) + 1)) AS i FROM w),
    o AS (SELECT doc_id, source, t[i] AS w, t[greatest(1, i - 3):i - 1] AS before, t[greatest(1, i - 6):i + 6] AS near FROM x WHERE list_contains({named((*_WORDS.positive, *_WORDS.negative))}, t[i])),
    p AS (SELECT doc_id, source, CASE {cases} ELSE 'uncategorised' END AS aspect, CASE WHEN list_contains({named(_WORDS.positive)}, w) THEN 1.0 ELSE -1.0 END * CASE WHEN list_has_any(before, {named(_WORDS.negators)}) THEN -1.0 ELSE 1.0 END AS polarity FROM o)"""


@query(f"""WITH {_polar_sql()}, d AS (SELECT doc_id, avg(polarity) AS overall FROM p GROUP BY 1),
g AS (SELECT source AS grp, count(*) AS respondents, round(round(avg(coalesce(overall, 0)), 4), 2) AS overall FROM documents LEFT JOIN d USING (doc_id) GROUP BY 1),
a AS (SELECT source AS grp, aspect, round(round(avg(polarity), 4), 2) AS score, count(*) AS mentions FROM p GROUP BY 1, 2)
SELECT g.grp, respondents < 5 AS suppressed, CASE WHEN respondents >= 5 THEN respondents END AS respondents, CASE WHEN respondents >= 5 THEN overall END AS overall, CASE WHEN respondents >= 5 THEN aspect END AS aspect,
CASE WHEN respondents >= 5 THEN score END AS score, CASE WHEN respondents >= 5 THEN mentions END AS mentions FROM g LEFT JOIN a ON a.grp = g.grp""")
def sentiment_groups(spark, sf_dir):
    out = sentiment.group_sentiment(table(spark, sf_dir, "documents"), "source", "text", _WORDS)
    return out.withColumn("overall", F.round("overall", 2)).withColumn("score", F.round("score", 2))


@query(f"""WITH {_polar_sql()}, a AS (SELECT source AS grp, doc_id // 20 % 2 AS half, aspect, round(avg(polarity), 4) AS score FROM p GROUP BY ALL), n AS (SELECT source AS grp, doc_id // 20 % 2 AS half, count(*) AS n FROM documents GROUP BY ALL)
SELECT c.grp, c.aspect, round(b.score, 4) AS previous, round(c.score, 4) AS current, round(b.score - c.score, 4) AS drop FROM a c JOIN a b ON b.grp = c.grp AND b.aspect = c.aspect AND b.half = 0 AND c.half = 1
JOIN n x ON x.grp = c.grp AND x.half = 0 AND x.n >= 5 JOIN n y ON y.grp = c.grp AND y.half = 1 AND y.n >= 5 WHERE b.score - c.score >= 0.04995""")
def sentiment_warnings(spark, sf_dir):
    """Aspects that fell by a twentieth or more from every other twenty documents to the twenty after them."""
    docs, half = table(spark, sf_dir, "documents"), F.expr("doc_id div 20 % 2")
    early, late = (sentiment.group_sentiment(docs.where(c), "source", "text", _WORDS) for c in (half == 0, half == 1))
    return sentiment.early_warnings(early, late, 0.04995).withColumn("drop", F.round("drop", 4))


_ALIASES = [("red", "color"), ("blue", "color"), ("green", "color"), ("ring", "jewel"), ("bolt", "metal"), ("gear", "metal"), ("widget", "device"), ("gizmo", "device")]
_ALIAS_SQL = "al(alias, skill) AS (VALUES " + ", ".join(f"('{a}', '{s}')" for a, s in _ALIASES) + ")"


def _holdings(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return planning.skill_holdings(joined.select(F.col("l_suppkey").alias("subject"), F.col("p_name").alias("text")), spark.createDataFrame(_ALIASES, "alias string, skill string"))


_HOLD_SQL = f"""{_ALIAS_SQL}, ev AS (SELECT l_suppkey AS subject, unnest(regexp_extract_all(lower(p_name), '[a-z][a-z0-9.+#-]*')) AS alias FROM lineitem JOIN part ON l_partkey = p_partkey),
h AS (SELECT subject, skill, count(*) AS mentions, 0::DOUBLE AS years, 1 AS level FROM ev JOIN al USING (alias) GROUP BY 1, 2)"""


@query(f"WITH {_HOLD_SQL} SELECT subject, skill, mentions, years, level FROM h")
def skill_mentions(spark, sf_dir):
    return _holdings(spark, sf_dir)


@query(f"""WITH {_HOLD_SQL}, rq(skill, required, demand) AS (VALUES ('metal', 1, 2000), ('jewel', 1, 5), ('device', 2, 10)), n AS (SELECT rq.skill, required, demand, count(DISTINCT CASE WHEN level >= required THEN subject END) AS n FROM rq LEFT JOIN h USING (skill) GROUP BY 1, 2, 3)
SELECT skill, required, CAST(floor(n * 0.9) AS BIGINT) AS supply, CAST(demand AS BIGINT) AS demand, CAST(greatest(0, demand - floor(n * 0.9)) AS BIGINT) AS shortfall FROM n""")
def skill_gaps(spark, sf_dir):
    needs = spark.createDataFrame([("metal", 1, 2000), ("jewel", 1, 5), ("device", 2, 10)], "skill string, required int, demand long")
    return planning.gap_forecast(_holdings(spark, sf_dir), needs, 0.1)


@query(f"""WITH {_HOLD_SQL}, rq(role, skill, required) AS (VALUES ('smith', 'metal', 1), ('smith', 'jewel', 2), ('painter', 'color', 1)), s AS (SELECT DISTINCT subject FROM h),
t AS (SELECT DISTINCT subject, role FROM h JOIN rq USING (skill)), m AS (SELECT t.subject, t.role, sum(least(coalesce(level, 0), required)) AS e, sum(required) AS a, max(required - coalesce(level, 0)) AS short FROM t JOIN rq ON rq.role = t.role LEFT JOIN h ON h.subject = t.subject AND h.skill = rq.skill GROUP BY 1, 2)
SELECT subject, role, round(e / a, 4) AS score, short <= 0 AS ready_now, short = 1 AS stretch FROM m""")
def role_matches(spark, sf_dir):
    needs = spark.createDataFrame([("smith", "craft", "metal", 1), ("smith", "craft", "jewel", 2), ("painter", "art", "color", 1)], "role string, family string, skill string, required int")
    return planning.match_roles(_holdings(spark, sf_dir), needs).select("subject", "role", "score", "ready_now", "stretch")


# Planning



def _departments(spark, sf_dir, *by):
    """Customers as staff of departments: a department loses more of them the more have a negative balance."""
    counts = table(spark, sf_dir, "customer").groupBy(*by).agg(F.count(F.lit(1)).alias("headcount"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("owing"))
    return counts.withColumn("attrition", (F.col("owing") + 1) / (F.col("headcount") * 9.7))


def _scenarios(spark, sf_dir):
    nation = F.col("c_nationkey")
    return _departments(spark, sf_dir, "c_nationkey", "c_mktsegment").select(
        F.concat_ws(":", "c_nationkey", "c_mktsegment").alias("name"), "headcount", "attrition", (1 + nation % 4).cast("long").alias("hires"), (nation % 5).cast("int").alias("ramp"), (F.col("headcount") * 1.05).alias("demand")
    )


_STATES = """WITH RECURSIVE s AS (SELECT c_nationkey || ':' || c_mktsegment AS name, count(*) AS h0, (count(*) FILTER (WHERE c_acctbal < 0) + 1) / (count(*) * CAST(9.7 AS DOUBLE)) AS a, 1 + c_nationkey % 4 AS hires, c_nationkey % 5 AS ramp, count(*) * CAST(1.05 AS DOUBLE) AS demand FROM customer GROUP BY c_nationkey, c_mktsegment),
m AS (SELECT name, 0 AS month, CAST(h0 AS DOUBLE) AS h, CAST(0 AS DOUBLE) AS leavers FROM s UNION ALL SELECT m.name, month + 1, h * (1 - a) + hires, h * a FROM m JOIN s USING (name) WHERE month < 12),
i AS (SELECT m.name, month, h, leavers, (SELECT coalesce(sum(hires * pow(1 - a, k) * (1 - k / ramp)), 0) FROM range(0, least(month, ramp)) t(k)) AS idle, hires, demand FROM m JOIN s USING (name) WHERE month > 0),
p AS (SELECT name, month, round(h, {d}) AS headcount, round(greatest(h - idle, 0), {d}) AS effective_capacity, round(leavers, {d}) AS leavers, hires AS joiners, demand FROM i)"""


@query(_STATES.format(d=6) + "SELECT name, CAST(month AS INT) AS month, headcount, effective_capacity, leavers, CAST(joiners AS BIGINT) AS joiners, demand, round(greatest(0, demand - effective_capacity), 6) AS shortfall FROM p")
def workforce_projection(spark, sf_dir):
    """A year of each nation's and market segment's customers as staff."""
    return planning.project(_scenarios(spark, sf_dir), digits=6).withColumn("shortfall", r6("shortfall"))


@query(_STATES.format(d=3) + """, q AS (SELECT *, round(greatest(0, demand - effective_capacity), 6) AS shortfall FROM p),
u AS (SELECT name, arg_max(headcount, month) AS final_headcount, round(sum(leavers), 3) AS total_leavers, CAST(sum(joiners) AS BIGINT) AS total_hires, CAST(min(month) FILTER (WHERE shortfall > 0) AS INT) AS first_shortfall_month,
max(shortfall) AS peak_shortfall, CAST(arg_max(month, shortfall * 1000 - month / 1000000) AS INT) AS peak_month FROM q GROUP BY 1) SELECT * FROM u""")
def workforce_summary(spark, sf_dir):
    states = planning.project(_scenarios(spark, sf_dir)).withColumn("shortfall", r6("shortfall"))
    return planning.projection_summary(states).drop("summary").withColumn("total_leavers", F.round("total_leavers", 3))


@query("""WITH t AS (SELECT CAST(c_nationkey AS VARCHAR) AS name, count(*) AS h0, (count(*) FILTER (WHERE c_acctbal < 0) + 1) / (count(*) * CAST(9.7 AS DOUBLE)) AS a, count(*) * 13 // 10 AS target FROM customer GROUP BY c_nationkey), n AS (SELECT *, unnest(range(0, target + h0 + 1)) AS k FROM t),
f AS (SELECT *, round(h0 * pow(1 - a, 12) + k * (1 - pow(1 - a, 12)) / a, 3) AS f FROM n) SELECT name, CAST(target AS BIGINT) AS target, CAST(min(k) AS BIGINT) AS hires FROM f WHERE f >= target GROUP BY 1, 2""")
def hires_required(spark, sf_dir):
    """Monthly hires that bring each nation's staff up by three in ten within a year."""
    staff = _departments(spark, sf_dir, "c_nationkey")
    return planning.hires_required(staff.select(F.col("c_nationkey").cast("string").alias("name"), "headcount", "attrition", F.floor(F.col("headcount") * 13 / 10).alias("target")))


@query("SELECT c_custkey, CASE WHEN c_acctbal / 10000 >= 0.6 THEN 'HIGH' WHEN c_acctbal / 10000 >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM customer")
def risk_bands(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.risk_band(F.col("c_acctbal") / 10000).alias("band"))


@query("""WITH m AS (SELECT avg(p_size) AS s, avg(p_retailprice) AS p FROM part), x AS (SELECT p_partkey, abs((p_size - s) / s) * 0.6 AS a, p_size > s AS ga, abs((p_retailprice - p) / p) * 0.4 AS b, p_retailprice > p AS gb FROM part, m)
SELECT p_partkey, CASE WHEN round(a, 12) >= round(b, 12) THEN CASE WHEN round(a, 12) = round(b, 12) THEN 'p_retailprice' ELSE 'p_size' END ELSE 'p_retailprice' END AS driver FROM x""")
def top_driver(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    m = part.agg(F.avg("p_size").alias("s"), F.avg("p_retailprice").alias("p")).first()
    told = planning.top_drivers({"p_size": F.col("p_size"), "p_retailprice": F.col("p_retailprice")}, {"p_size": m["s"], "p_retailprice": m["p"]}, {"p_size": 0.6, "p_retailprice": 0.4})
    return part.select("p_partkey", told[0]["feature"].alias("driver"))


# Determinism, ledger, governance


@query("""WITH c AS (SELECT conv_id AS "case", role AS output, count(*) AS n FROM conversations GROUP BY 1, 2), s AS (SELECT "case", sum(n) AS reps, count(*) AS d, max(n) / sum(n) AS share, arg_min(output, (-n, output)) AS mode FROM c GROUP BY 1)
SELECT "case", CAST(reps AS BIGINT) AS repetitions, d AS distinct_outputs, mode AS modal_output, round(share, 6) AS modal_share,
CASE WHEN d = 1 THEN 'DETERMINISTIC' WHEN share >= 0.95 THEN 'NEAR_DETERMINISTIC' WHEN share >= 0.6 THEN 'UNSTABLE' ELSE 'NON_DETERMINISTIC' END AS stability FROM s""")
def determinism(spark, sf_dir):
    return statistics.determinism(table(spark, sf_dir, "conversations"), "conv_id", "role").drop("passes").withColumn("modal_share", r6("modal_share"))


@query()
def fidelity(spark, sf_dir):
    cases = statistics.determinism(table(spark, sf_dir, "conversations"), "conv_id", "role")
    drift = statistics.ks_test(_drift_values(spark, sf_dir)).select("feature", "severity", "statistic")
    return statistics.fidelity(cases, drift)


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 8).cast("string")).alias("tenant_id"), F.lit("feed").alias("workflow"), F.col("user_id").cast("string").alias("run_id"), F.lit("s").alias("step"), F.col("event_type").alias("action_type"),
        F.col("user_id").cast("string").alias("subject_id"), F.lit("agent").alias("agent"), F.lit("ALLOW").alias("outcome"), F.array("event_type").alias("reasons"), F.when(F.col("event_id") % 5 == 0, F.lit("ann")).alias("approver"), F.col("ts").cast("timestamp").alias("recorded_at"), F.col("event_id").alias("write_seq"),
    )


@query("SELECT 't' || (user_id % 8) AS tenant_id, TRUE AS intact, count(*) AS entries_checked FROM events GROUP BY 1")
def ledger_round_trip(spark, sf_dir):
    return ledger.verify(ledger.append(_entries(spark, sf_dir), key=b"k" * 16), b"k" * 16).select("tenant_id", "intact", "entries_checked")


@query("""WITH p AS (SELECT event_id, CAST(event_id AS VARCHAR) AS a, event_type AS b FROM events) SELECT event_id, sha256(length(a) || ':' || a || length(b) || ':' || b) AS digest FROM p""")
def canonical_hash(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.sha2(hashing.length_prefixed(F.col("event_id"), F.col("event_type")), 256).alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'DENY' WHEN o_orderstatus = 'P' OR o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') OR o_totalprice / 500000 < 0.3 THEN 'REQUIRE_HUMAN_APPROVAL' ELSE 'ALLOW' END AS verdict FROM orders""")
def governance_gate(spark, sf_dir):
    o, tenant = table(spark, sf_dir, "orders"), F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string"))
    actions = o.select(F.col("o_orderkey").alias("action_id"), tenant.alias("tenant_id"), tenant.alias("policy_tenant"), F.col("o_orderpriority").alias("action_type"), F.array().cast("array<string>").alias("domains"), (F.col("o_orderstatus") == "P").alias("irreversible"), (F.col("o_totalprice") / 500000).alias("confidence"))
    policy = spark.createDataFrame([(f"t{k}", ["4-NOT SPECIFIED", "5-LOW"], ["1-URGENT"], [], 0.3, "lead") for k in range(4)], "tenant_id string, autonomous array<string>, forbidden array<string>, readable array<string>, floor double, approver_role string")
    return governance.gate(actions, policy).select(F.col("action_id").alias("o_orderkey"), "verdict")


@query("""SELECT l_orderkey AS run_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'FAILED' WHEN bool_and(l_returnflag = 'A') THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM lineitem GROUP BY 1""")
def run_status(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_returnflag") == "A", "COMPLETED").otherwise("RUNNING").alias("status"))
    return governance.run_status(steps)


# Streams


def _event_stream(spark, sf_dir):
    return streams.read_stream(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_idempotent(spark, sf_dir):
    s = _event_stream(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.col("event_type").alias("item_id"), F.col("ts").cast("timestamp").alias("at"))
    return streams.drain(streams.idempotent_feedback(s, "60 days")).select(F.col("request_id").alias("user_id"), F.col("item_id").alias("event_type"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    out = streams.drain(streams.event_windows(_event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query()
def stream_rate_limited(spark, sf_dir):
    s = _event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    return streams.drain(streams.rate_limited(s, 2, 7200))


@query("""WITH k AS (SELECT user_id % 2 AS w, event_id, event_type, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id DESC) AS k FROM events)
SELECT CASE WHEN w = 0 THEN 'live' ELSE 'canary' END AS "window", count(*) AS impressions, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM k WHERE k <= 500 GROUP BY 1""")
def stream_count_window(spark, sf_dir):
    s = _event_stream(spark, sf_dir).select(F.when(F.col("user_id") % 2 == 0, "live").otherwise("canary").alias("window"), F.col("event_id").alias("seq"), F.col("event_id").alias("request_id"), (F.col("event_type") == "click").alias("clicked"), F.lit(False).alias("is_credit"))
    return streams.drain(streams.count_window(s, 500), "update")

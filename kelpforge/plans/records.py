"""More registered queries: record keeping, feeds, models, sources and workflows over the driver's tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from kelpforge.functions import hashing, numeric, text
from kelpforge.operators import calendar, features, governance, ledger, models, planning, privacy, proximity, ranking, retrieval, statistics, stored_index, stored_ledger, tables, towers
from kelpforge.plans.catalog import _VECTORS, _baskets, _entries, _vectors, query, r6, table
from kelpforge.sources import files
from kelpforge.sources.shared import scratch, settle
from kelpforge.streaming import alerts, guard, streams

# Projections and predicates


@query("""SELECT o_custkey AS user_id, o_orderkey AS item_id, CAST(o_totalprice AS DOUBLE) AS price, CAST(c_acctbal AS DOUBLE) AS balance, 0::DOUBLE AS unknown FROM orders JOIN customer ON o_custkey = c_custkey""")
def candidate_features(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("item_id"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"), F.lit(-1.0).alias("price"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("price"))
    known = c.join(users.select("user_id"), "user_id", "left_semi")
    return ranking.candidate_features(known, users, items, ["price", "balance", "unknown"])


@query("""SELECT 'p' || p_partkey AS subject_key, CAST(p_size AS DOUBLE) AS tenure_years, round(p_retailprice / 1000.0, 6) AS compensation_ratio_to_band, round(p_retailprice / 1200.0, 6) AS compensation_ratio_to_peers, 3::DOUBLE AS engagement_score, 0::DOUBLE AS commute_minutes FROM part""")
def attrition_features(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("subject_key"), F.col("p_size").alias("tenure_years"), F.col("p_retailprice").alias("salary"), F.lit(1000.0).alias("band_midpoint"), F.lit(1200.0).alias("peer_median_salary"))
    out = planning.attrition_features(p)
    return out.select("subject_key", "tenure_years", r6("compensation_ratio_to_band").alias("compensation_ratio_to_band"), r6("compensation_ratio_to_peers").alias("compensation_ratio_to_peers"), "engagement_score", "commute_minutes")


@query("""SELECT p_partkey, CASE WHEN p_size >= 45 THEN '45_plus' WHEN p_size >= 30 THEN '30_to_44' ELSE 'under_30' END AS age, CASE WHEN p_retailprice / 2000 >= 0.75 THEN 'ADVANCE' WHEN p_retailprice / 2000 >= 0.45 THEN 'REVIEW' ELSE 'HOLD' END AS advice,
CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size / 10 >= 5 AND p_size % 5 >= 2 THEN 4 WHEN p_size / 10 >= 3 THEN 3 WHEN p_size / 10 >= 1 THEN 2 ELSE 1 END AS level FROM part""")
def band_labels(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", numeric.age_band(size).alias("age"), numeric.recommendation(F.col("p_retailprice") / 2000).alias("advice"), numeric.proficiency(size % 5, size / 10).alias("level"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus = 'F'")
def actor_filter(spark, sf_dir):
    return tables.actors(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "people", "o_orderpriority").select("o_orderkey")


@query("SELECT event_id, CASE WHEN user_id > 50 THEN 'zone' ELSE 'user,zone' END AS missing FROM events")
def missing_context(spark, sf_dir):
    context = F.create_map(F.lit("k"), F.lit("v"), F.lit("user"), F.when(F.col("user_id") > 50, F.col("user_id").cast("string")).otherwise(""))
    needed = F.array(F.lit("k"), F.lit("user"), F.lit("zone"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(governance.missing_context(needed, context)), ",").alias("missing"))


@query("SELECT doc_id, sha256(replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss')) AS normalised FROM documents")
def text_normaliser(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalise(F.col("text"), "space case"), 256).alias("normalised"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('us', ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS at FROM events")
def iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hashing.iso_timestamp(F.col("ts")).alias("at"))


@query()
def row_signatures(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", hashing.hmac_sha256(b"key", hashing.length_prefixed(F.col("event_id"), F.col("event_type"))).alias("signature"))


@query("SELECT o_orderkey, substr(sha256(length(a) || ':' || a || length(o_orderstatus) || ':' || o_orderstatus), 1, 16) AS fingerprint FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS a FROM orders)")
def row_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.fingerprint16(F.col("o_orderkey"), F.col("o_orderstatus")).alias("fingerprint"))


@query("""WITH s AS (SELECT p_partkey, p_size / 50.0 AS a, p_size * 1.0 AS b FROM part) SELECT p_partkey, round((2 * least(1, greatest(0, a)) + CASE WHEN b <= 1 THEN b ELSE least(1, b / 10) END) / 3, 6) AS score FROM s""")
def signal_scores(spark, sf_dir):
    signals = F.create_map(F.lit("skill_match"), F.col("p_size") / 50.0, F.lit("years"), F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", r6(privacy.signal_score(signals, F.lit(10.0))).alias("score"))


@query()
def screening_pipeline(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("full_name"), (F.col("c_acctbal") / 10_000).alias("skill_match"), F.lit(7.0).alias("years_experience"))
    return privacy.screen(people, privacy.Policy("sixteen-byte-salt", 2024), "at least ten years of practice")


# Tables


@query("SELECT count(*) AS total, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks FROM events")
def feedback_summary(spark, sf_dir):
    return tables.feedback_summary(table(spark, sf_dir, "events").select((F.col("event_type") == "click").alias("clicked")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00')")
def retention_prune(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    import datetime as dt

    _, kept = tables.prune(orders, table(spark, sf_dir, "lineitem"), "l_orderkey", "o_orderdate", dt.datetime(1997, 1, 1))
    return kept.select("l_orderkey", "l_linenumber")


@query("""WITH a AS (SELECT user_id AS alert_id, count(*) AS attempts, bool_or(event_type = 'purchase' AND value > 200) AS done FROM events WHERE event_type IN ('error', 'purchase') AND value > 150 GROUP BY 1)
SELECT c_custkey AS alert_id, coalesce(attempts, 0) AS attempts FROM customer LEFT JOIN a ON alert_id = c_custkey WHERE NOT coalesce(done, FALSE) AND coalesce(attempts, 0) < 5""")
def pending_alerts(spark, sf_dir):
    tries = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase') AND value > 150").select(F.col("user_id").alias("alert_id"), ((F.col("event_type") == "purchase") & (F.col("value") > 200)).alias("delivered"))
    return tables.pending_alerts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("alert_id")), tries).select("alert_id", "attempts")


@query("SELECT event_id, user_id FROM events e JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0 AND (c_nationkey % 2 = 0 OR e.ts >= TIMESTAMP '2024-01-10 00:00:00')")
def valid_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key_id"), F.lit("t").alias("tenant_id"), F.col("ts").alias("issued_at"))
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), F.lit("t").alias("tenant_id"), (F.col("c_acctbal") > 0).alias("active"), F.when(F.col("c_nationkey") % 2 == 1, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).alias("not_before"))
    return tables.valid_tokens(tokens, keys).select("event_id", F.col("key_id").alias("user_id"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'live' ELSE 'r' || n_regionkey END AS \"window\" FROM nation WHERE n_regionkey <> 0")
def window_promotion(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("window", F.when(F.col("n_regionkey") == 0, F.lit("live")).otherwise(F.concat(F.lit("r"), "n_regionkey")))
    return tables.relabel_window(n, "r1", "live").select("n_nationkey", "window")


@query("""WITH h AS (SELECT o_orderkey, o_orderstatus, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) ELSE concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) END AS key_id FROM h""")
def backfilled_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("key_id", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")))
    return tables.backfill(o, "key_id", "o_orderkey").select("o_orderkey", "key_id")


@query("""SELECT o_custkey, array_to_string(list(o_orderstatus ORDER BY o_orderdate, o_orderkey), ',') AS history FROM orders GROUP BY 1""")
def version_history(spark, sf_dir):
    told = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(told, lambda s: s["o_orderstatus"]), ",").alias("history"))


@query("SELECT e.event_id, e.user_id FROM events e JOIN (SELECT o_custkey, list(DISTINCT o_orderkey % 50) AS items FROM orders GROUP BY 1) i ON e.user_id = i.o_custkey WHERE list_contains(items, e.event_id % 50) QUALIFY row_number() OVER (PARTITION BY e.user_id, e.event_id % 50 ORDER BY e.ts) = 1")
def credited_feedback(spark, sf_dir):
    shown = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request_id")).agg(F.collect_set(F.col("o_orderkey") % 50).alias("items"))
    clicks = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("request_id"), (F.col("event_id") % 50).alias("item_id"), F.col("ts").alias("at"))
    return tables.credited_feedback(clicks, shown).select("event_id", F.col("request_id").alias("user_id"))


# Feeds


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = table(spark, sf_dir, "events").groupBy("event_type").agg(p.alias("p"), F.count(F.lit(1)).alias("n"))
    return out.select("event_type", *(r6(F.col("p")[k]).alias(c) for k, c in enumerate(("p50", "p95", "p99"))), "n")


@query("SELECT user_id, count(DISTINCT event_type) AS topics FROM events GROUP BY 1")
def distinct_topics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("topics"))


@query("""WITH s AS (SELECT user_id, event_type, max(value) AS s FROM events GROUP BY 1, 2), t AS (SELECT user_id, s AS own FROM s WHERE event_type = 'click'),
seen AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND value > 100)
SELECT t.user_id, 'click' AS event_type, CAST(count(*) FILTER (WHERE s.event_type = 'click' OR s >= own) AS BIGINT) AS rank FROM s JOIN t USING (user_id) WHERE NOT (s.event_type = 'signup' AND s.user_id IN (SELECT user_id FROM seen)) GROUP BY 1""")
def target_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    scores = e.groupBy("user_id", "event_type").agg(F.max("value").alias("s"))
    seen = e.where("event_type = 'signup' AND value > 100").select("user_id", "event_type")
    targets = scores.where("event_type = 'click'").select("user_id", "event_type")
    return ranking.target_rank(scores, seen, targets, "user_id", "event_type", "s")


@query()
def evaluation_summary(spark, sf_dir):
    return ranking.evaluation_summary(table(spark, sf_dir, "events").select("event_id", (1 + F.col("event_id") % 37).alias("rank")), "rank", 10, 500)


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label || ':' || (vec_id // 60) AS page FROM embeddings) SELECT a.page, a.vec_id AS item_a, b.vec_id AS item_b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS similarity FROM e a JOIN e b USING (page)""")
def page_gram_matrix(spark, sf_dir):
    """The vectors of a label are dealt into pages by blocks of 60 ids."""
    m = table(spark, sf_dir, "embeddings").withColumn("page", F.expr("concat(label, ':', vec_id div 60)"))
    return ranking.gram(m, "page", "vec_id", "embedding").withColumn("similarity", r6("similarity"))


@query()
def graph_recall(spark, sf_dir):
    """Recall at 10 of a proximity graph that is built once, at four search budgets."""
    queries, corpus = _vectors(spark, sf_dir)
    return proximity.recall_by_budget(queries, proximity.build_graph(corpus), retrieval.exact_neighbours(queries, corpus, 10), 10)


@query()
def index_recall(spark, sf_dir):
    """Recall at 10 of a stored index before and after compaction: a third of the keys come later, a tenth of all are replaced, some withdrawn."""
    queries, corpus = _vectors(spark, sf_dir)
    index = stored_index.StoredIndex(spark, scratch(spark, "index"))
    turned = corpus.select("id", F.transform("vector", lambda x: -x).alias("vector"))
    index.put(corpus.where("id % 3 <> 0").unionByName(turned.where("id % 10 = 0 AND id % 3 <> 0")))
    index.compact()
    index.put(corpus.where("id % 3 = 0"))
    index.put(turned.where("id % 10 = 1"))
    index.withdraw(corpus.where("id % 50 = 7").select("id"))
    exact = settle(retrieval.exact_neighbours(queries, index.live(), 10))
    share = lambda stage: retrieval.recall_against(index.search(queries, 10, 96), exact).agg(F.avg("recall").alias("recall")).select(F.lit(stage).alias("stage"), "recall")
    before = settle(share("changes beside the base"))
    index.compact()
    return before.union(share("compacted"))


def _bought(spark, sf_dir):
    """Customers' newest part as test, the one before as validation, the rest to train on: id, item, part."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = bought.select(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("item"), F.lit(5).alias("rating"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return settle(ranking.leave_last_out(rows, "id", "item", "rating", "at"))


def _weighed(rows):
    return rows.groupBy(F.col("id").cast("int").alias("user"), F.col("item").cast("int").alias("item")).agg(F.count(F.lit(1)).cast("float").alias("weight"))


@query()
def factor_recommendations(spark, sf_dir):
    """The ten best parts that they haven't bought, for customers whose number is divisible by 20."""
    rows = _baskets(spark, sf_dir).select(F.col("u").alias("id"), F.col("i").alias("item"))
    asked = rows.where("id % 20 = 0")
    return retrieval.factor_recommendations(retrieval.factor_model(_weighed(rows), rank=8, rounds=3), asked.select(F.col("id").cast("int").alias("id")), 10, asked)


TOWERS = towers.TowerConfig(dimension=16, epochs=4, shard_rows=100_000)


@query()
def two_tower_recommendations(spark, sf_dir):
    """As factor_recommendations, by the two-tower model."""
    rows = _baskets(spark, sf_dir).select(F.col("u").alias("id"), F.col("i").alias("item"))
    asked = rows.where("id % 20 = 0")
    found = towers.retrieve(towers.train_towers(rows, "id", "item", TOWERS), asked.select("id"), 10, asked)
    return found.select(F.col("query_id").cast("long").alias("user"), F.col("item_id").cast("long").alias("item"), "score", "rank")


@query()
def two_tower_evaluation(spark, sf_dir):
    """Hit rate, NDCG and MRR at 10 of the newest part of customers whose number is divisible by 20, by model; losses of the first and last epoch."""
    rows = _bought(spark, sf_dir)
    train, test = rows.where("part = 'train'"), rows.where("part = 'test' AND id % 20 = 0").select("id", "item")
    seen = rows.where("part <> 'test' AND id % 20 = 0").select("id", "item")
    model = towers.train_towers(train, "id", "item", TOWERS)
    kept = lambda t: t.select(F.col("id").cast("long").alias("id"), "vector")
    counts = ranking.popularity(train, "item").select(F.col("item").alias("id"), F.array(F.col("n").cast("float")).alias("vector"))
    everyone = test.select("id", F.array(F.lit(1.0).cast("float")).alias("vector")).distinct()
    told = [
        ("two_tower", kept(model.users), kept(model.items), model.losses[0], model.losses[-1]),
        ("factors", *map(kept, retrieval.factors(retrieval.factor_model(_weighed(train), rank=16, rounds=4))), None, None),
        ("popularity", everyone, counts, None, None),
    ]
    out = None
    for name, users, items, first, last in told:
        ranks = retrieval.held_out_ranks(users, items, test, seen)
        row = ranking.evaluation_summary(ranks, "rank", 10, 500).select(F.lit(name).alias("model"), "*", F.lit(first).cast("double").alias("first_loss"), F.lit(last).cast("double").alias("last_loss"))
        out = out.union(row) if out else row
    return out


@query(f"""WITH {_VECTORS}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_dot_product(a.v, b.v), 12) AS s FROM u a, u b WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS rank FROM p) SELECT query_id, item_id, CAST(rank AS INT) AS rank FROM k WHERE rank BETWEEN 6 AND 20""")
def reserve_pool(spark, sf_dir):
    queries, corpus = _vectors(spark, sf_dir)
    near = retrieval.exact_neighbours(queries, corpus, 20)
    return retrieval.exclude(near, near.where("rank <= 5"), "query_id", "item_id").select("query_id", "item_id", "rank")


@query("""WITH t AS (SELECT l.user_id, l.event_id, coalesce((SELECT arg_max(value, ts) FROM events f WHERE f.user_id = l.user_id AND f.event_type = 'view' AND f.ts <= l.ts), 0) AS "view" FROM events l WHERE l.event_type = 'purchase') SELECT * FROM t""")
def training_rows(spark, sf_dir):
    view = features.FeatureView("long", [features.Feature("view")], ttl_seconds=10**9)
    e = table(spark, sf_dir, "events")
    writes = e.where("event_type = 'view'").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("event_time"), F.col("event_id").alias("write_seq"), F.create_map("event_type", "value").alias("values"))
    labels = e.where("event_type = 'purchase'").select(F.col("user_id").alias("entity_id"), F.col("ts").alias("label_time"), "event_id")
    return features.point_in_time_join(view, labels, writes).select(F.col("entity_id").alias("user_id"), "event_id", "view")


@query("""WITH l AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS label FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT k, user_id, item_id, label, CAST(c_acctbal AS DOUBLE) AS balance, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS BIGINT) AS size, CASE WHEN c_custkey IS NULL OR p_partkey IS NULL THEN 0 ELSE round(c_acctbal * p_retailprice + 10.0 * p_size, 4) END AS retrieval_score
FROM l LEFT JOIN customer ON c_custkey = user_id LEFT JOIN part ON p_partkey = item_id""")
def training_assembly(spark, sf_dir):
    """Every bought part as a label, with the views and vectors of its customer and part."""
    bought = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    labels = bought.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("label"))
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    users, items = c.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("balance")), p.select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("long").alias("size"))
    user_vectors = users.select("user_id", F.array("balance", F.lit(10.0)).alias("vector"))
    item_vectors = items.select("item_id", F.array("price", F.col("size").cast("double")).alias("vector"))
    rows = features.assemble_training_rows(labels, users, items, user_vectors, item_vectors)
    return rows.select("k", "user_id", "item_id", "label", "balance", "price", "size", F.round("retrieval_score", 4).alias("retrieval_score"))


# Models


def _staff(spark, sf_dir):
    """Customers as employees: orders are their work, and the three in ten whose last one is the longest ago have left."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.avg("o_totalprice").alias("price"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("urgent")
    )
    days = lambda c: F.datediff(F.lit("1998-08-02").cast("date"), F.col(c).cast("date"))
    own = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    late = orders.agg(F.percentile(days("last"), 0.7)).first()[0]
    return own.select(
        F.concat(F.lit("c"), "c_custkey").alias("subject_key"), (days("first") / 365).alias("tenure_years"), (F.col("c_custkey") % 36).cast("double").alias("months_since_promotion"), F.col("orders").cast("double").alias("training_hours_12m"),
        F.col("urgent").cast("double").alias("overtime_hours_monthly"), (1 + (F.col("c_acctbal") + 1000) / 2750).alias("engagement_score"), (F.coalesce("price", F.lit(0.0)) + 1).alias("salary"), F.lit(150_000.0).alias("band_midpoint"),
        F.lit(140_000.0).alias("peer_median_salary"), (F.coalesce(days("last"), F.lit(9999)) > F.lit(late)).cast("int").alias("left"),
    )


@query()
def attrition_scores(spark, sf_dir):
    """Boosted trees that tell customers who have stopped ordering from the others, with bands and drivers."""
    people = _staff(spark, sf_dir)
    rows = settle(planning.attrition_features(people).join(people.select("subject_key", "left"), "subject_key"))
    names = [c for c in rows.columns if c not in ("subject_key", "left")]
    model = models.train(rows, names, "left", "gradient_boosting")
    means, weight = models.cohort_means(rows, names), models.importance(model, names)
    scored = models.score(model, rows, names)
    return scored.select("subject_key", F.round("probability", 6).alias("probability"), numeric.risk_band(F.col("probability")).alias("band"), planning.top_drivers({n: F.col(n) for n in names}, means, weight).alias("drivers"))


@query()
def ranker_report(spark, sf_dir):
    """Boosted trees over orders: which are finished; Platt's map and the AUC of the held-out quarter."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), days.alias("age"), F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    _, (slope, intercept), auc = models.train_ranker(settle(rows), ["age", "price"], "label", "k")
    return spark.createDataFrame([(slope, intercept, auc)], "slope double, intercept double, auc double")


_TOOLING = "round(coalesce({t}, 0.5) + (c_acctbal + 1000) / 11000, 9) > 1.0"


@query(f"""WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority < '3') / CAST(count(*) AS DOUBLE) AS t FROM orders GROUP BY 1), c AS (SELECT c_mktsegment AS grp, {_TOOLING.format(t='t')} AS a, {_TOOLING.format(t='NULL')} AS b FROM customer LEFT JOIN o ON o_custkey = c_custkey),
v AS (SELECT 'all_columns' AS variant, grp, count(*) AS total, count(*) FILTER (WHERE a) AS selected FROM c GROUP BY 2 UNION ALL SELECT 'without_recent_tooling', grp, count(*), count(*) FILTER (WHERE b) FROM c GROUP BY 2),
r AS (SELECT *, selected / CAST(total AS DOUBLE) AS rate, total >= 30 AS eligible FROM v), w AS (SELECT *, max(rate) FILTER (WHERE eligible) OVER (PARTITION BY variant) AS best, count(*) FILTER (WHERE eligible) OVER (PARTITION BY variant) AS parties FROM r),
x AS (SELECT *, CASE WHEN parties >= 2 AND best > 0 AND eligible THEN rate / best END AS ratio FROM w)
SELECT variant, grp, total, selected, round(rate, 6) AS rate, eligible, round(ratio, 6) AS ratio, coalesce(ratio < 0.8, FALSE) AS impacted,
CASE WHEN parties < 2 OR coalesce(best, 0) <= 0 THEN 'INSUFFICIENT_DATA' WHEN bool_or(coalesce(ratio < 0.8, FALSE)) OVER (PARTITION BY variant) THEN 'ADVERSE_IMPACT' ELSE 'NO_ADVERSE_IMPACT' END AS verdict FROM x""")
def impact_of_tooling(spark, sf_dir):
    """Customers are screened by their balance and the share of their orders that are urgent or high, and again without that share."""
    share = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count(F.when(F.col("o_orderpriority") < "3", 1)) / F.count(F.lit(1))).alias("recent_tooling"))
    people = table(spark, sf_dir, "customer").join(share, "c_custkey", "left")
    screen = lambda d: F.round(F.coalesce("recent_tooling", F.lit(0.5)) + (F.col("c_acctbal") + 1000) / 11000, 9) > 1.0
    return statistics.rescreened(people, "c_mktsegment", screen, "recent_tooling").withColumn("rate", r6("rate")).withColumn("ratio", r6("ratio"))


# Ledger and workflows


@query("SELECT 't' || (user_id % 8) AS tenant_id, max(rn) AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 1")
def ledger_heads(spark, sf_dir):
    return ledger.heads(ledger.append(_entries(spark, sf_dir))).select("tenant_id", "sequence")


@query("SELECT 't' || (user_id % 8) AS tenant_id, count(*) AS approvals FROM events WHERE event_id % 5 = 0 GROUP BY 1")
def human_approvals(spark, sf_dir):
    return ledger.human_approvals(ledger.append(_entries(spark, sf_dir))).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("approvals"))


@query("""WITH b AS (SELECT user_id % 8 AS t, event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS s FROM events), x AS (SELECT t, min(s) AS broken FROM b WHERE event_id % 997 = 5 GROUP BY 1)
SELECT 't' || t AS tenant_id, broken IS NULL AS intact, broken AS broken_at, coalesce(broken, count(*)) AS entries_checked FROM b LEFT JOIN x USING (t) GROUP BY 1, 2, 3""")
def ledger_tampering(spark, sf_dir):
    book = ledger.append(_entries(spark, sf_dir))
    marks = _entries(spark, sf_dir).where("write_seq % 997 = 5").select("tenant_id", "recorded_at", F.lit(True).alias("hit"))
    bad = book.join(marks, ["tenant_id", "recorded_at"], "left").withColumn("outcome", F.when(F.col("hit"), F.lit("DENY")).otherwise(F.col("outcome"))).drop("hit")
    return ledger.verify(bad).select("tenant_id", "intact", "broken_at", "entries_checked")


@query()
def evidence_manifest(spark, sf_dir):
    return ledger.evidence_manifest(ledger.append(_entries(spark, sf_dir)), "t3", b"key")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem GROUP BY 1, 2)
SELECT a.l_orderkey AS run_id, CAST(a.l_linenumber AS VARCHAR) AS step FROM f a LEFT JOIN f b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber - 1 WHERE a.lo = 'N' AND a.hi = 'N' AND (a.l_linenumber = 1 OR (b.lo = 'A' AND b.hi = 'A'))""")
def runnable_steps(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"))
    status = F.when((F.col("lo") == "A") & (F.col("hi") == "A"), "COMPLETED").when((F.col("lo") == "N") & (F.col("hi") == "N"), "PENDING").otherwise("AWAITING_APPROVAL")
    needs = F.when(F.col("l_linenumber") > 1, F.array((F.col("l_linenumber") - 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    steps = one.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("string").alias("step"), status.alias("status"), needs.alias("requires"), F.lit(False).alias("optional"))
    return governance.runnable_steps(steps)


@query()
def workflow_folds(spark, sf_dir):
    definition = spark.createDataFrame(governance.WORKFLOWS, governance.WORKFLOW_COLUMNS)
    e = table(spark, sf_dir, "events")
    kinds = F.element_at(F.array(*map(F.lit, ("start", "succeed", "fail", "retry", "approve"))), (F.col("event_id") % 5 + 1).cast("int"))
    steps = F.element_at(F.array(*map(F.lit, ("collect", "score", "decide"))), (F.col("event_id") % 3 + 1).cast("int"))
    events = e.select(F.col("user_id").alias("run_id"), F.when(F.col("user_id") % 2 == 0, "screening").otherwise("mobility").alias("workflow"), F.col("event_id").alias("seq"), kinds.alias("kind"), steps.alias("step"), F.lit("ann").alias("actor"))
    return governance.fold_runs(definition, events)


@query("""WITH e AS (SELECT event_type AS name, user_id AS version, event_id AS seq, ['DRAFT', 'SHADOW', 'CANARY', 'LIVE', 'ROLLED_BACK', 'ARCHIVED'][event_id % 6 + 1] AS stage FROM events),
b AS (SELECT *, lag(stage) OVER (PARTITION BY name, version ORDER BY seq) AS before FROM e),
w AS (SELECT name, arg_max(version, seq) AS gone, max(seq) AS gone_at FROM b WHERE before = 'LIVE' AND stage IN ('ROLLED_BACK', 'ARCHIVED') GROUP BY 1),
o AS (SELECT name, version, arg_max(stage, seq) AS stage, max(seq) AS last_seq, string_agg(stage, ',' ORDER BY seq) AS history FROM e GROUP BY 1, 2),
d AS (SELECT * REPLACE (CASE WHEN stage IN ('LIVE', 'CANARY', 'SHADOW') AND row_number() OVER (PARTITION BY name, stage ORDER BY last_seq DESC) > 1 THEN 'ARCHIVED' ELSE stage END AS stage) FROM o),
r AS (SELECT d.name, max(d.version) AS version FROM d JOIN w USING (name) WHERE d.stage = 'ARCHIVED' AND d.version <> w.gone AND d.last_seq < w.gone_at AND d.name NOT IN (SELECT name FROM d WHERE stage = 'LIVE') GROUP BY 1)
SELECT d.name, d.version, CASE WHEN r.version IS NOT NULL THEN 'LIVE' ELSE d.stage END AS stage, d.history FROM d LEFT JOIN r ON d.name = r.name AND d.version = r.version""")
def registry_stages(spark, sf_dir):
    stages = F.element_at(F.array(*map(F.lit, governance.EDGES)), (F.col("event_id") % 6 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("version"), F.col("event_id").alias("seq"), stages.alias("stage"))
    return governance.current_stages(events).withColumn("history", F.array_join("history", ","))


@query("SELECT p_brand AS name, max(p_partkey) AS version FROM part WHERE p_type <> 'ECONOMY' AND p_size > 5 GROUP BY 1")
def eligible_versions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_type <> 'ECONOMY' AND p_size > 5")
    return tables.latest(rows, ["p_brand"], "p_partkey").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"))


# Sources and scheduled checks


@query("SELECT o_orderkey, '''=' || o_orderpriority AS note, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "records")
    files.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("="), "o_orderpriority").alias("note"), F.col("o_totalprice").alias("price")), path)
    return spark.read.schema("o_orderkey long, note string, price double").csv(path, header=True)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 90")
def checked_json(spark, sf_dir):
    good, _ = files.parse_checked(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k long", {"k in range": F.col("body.k").between(10, 90)})
    return good.select("event_id", "k")


@query()
def evidence_round_trip(spark, sf_dir):
    path = scratch(spark, "records")
    book = ledger.append(_entries(spark, sf_dir).where("tenant_id = 't2'"), key=b"key")
    files.write_evidence(book, ledger.evidence_manifest(book, "t2", b"key"), path)
    manifest, back = files.read_evidence(spark, path, ledger.ENTRY)
    wrong = ledger.verify_evidence(back, manifest, b"key")
    return spark.createDataFrame([(back.count(), len(wrong))], "entries long, faults int")


_CHECKS = """WITH v AS (SELECT f.feature, CASE f.feature WHEN 'value' THEN value ELSE CAST(user_id AS DOUBLE) END AS value, ts >= TIMESTAMP '2024-01-11 00:00:00' AS is_live
FROM events, (VALUES ('value'), ('user')) f(feature) WHERE ts < TIMESTAMP '2024-01-11 00:00:00' OR ts > TIMESTAMP '2024-02-12 00:00:00' - INTERVAL 30 DAYS),
q AS (SELECT feature, min(value) AS lo, max(value) AS hi, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM v WHERE NOT is_live GROUP BY 1),
b AS (SELECT v.feature, len(list_filter(q.edges, lambda e: e <= v.value AND e > q.lo AND e < q.hi)) AS bin, count(*) FILTER (WHERE NOT is_live) AS nr, count(*) FILTER (WHERE is_live) AS nl FROM v JOIN q USING (feature) GROUP BY 1, 2),
s AS (SELECT feature, greatest(1e-6, nr / sum(nr) OVER (PARTITION BY feature)) AS r, greatest(1e-6, nl / sum(nl) OVER (PARTITION BY feature)) AS l FROM b),
d AS (SELECT coalesce(string_agg(feature, ', ' ORDER BY feature), '') AS names FROM (SELECT feature FROM s GROUP BY 1 HAVING sum((l - r) * ln(l / r)) >= 0.25)),
n AS (SELECT count(*) AS n FROM v WHERE is_live AND feature = 'value')
SELECT 'ledger' AS name, TRUE AS passed, '0 broken chains' AS detail
UNION ALL SELECT 'live_drift', n < 200 OR names = '', n || CASE WHEN n < 200 THEN ' rows are too few to tell' WHEN names = '' THEN ' rows, no drift' ELSE ' rows, drift of ' || names END FROM n, d
UNION ALL SELECT 'retrain', n < 200 OR names = '', CASE WHEN n < 200 OR names = '' THEN 'trained 32 days ago' ELSE 'what is scored has drifted' END FROM n, d"""


@query(_CHECKS)
def scheduled_checks(spark, sf_dir):
    """The model was trained on the events before 11 January and has scored those since."""
    e = table(spark, sf_dir, "events").select("value", F.col("user_id").cast("double").alias("user"), F.col("ts").alias("at"))
    trained = F.lit("2024-01-11").cast("timestamp_ntz")
    return streams.scheduled_checks(settle(ledger.append(_entries(spark, sf_dir))), e.where(F.col("at") < trained), e.where(F.col("at") >= trained), ["user", "value"], "2024-01-11", "2024-02-12")


@query("SELECT 't' || (user_id % 8) AS tenant_id, TRUE AS intact, count(*) AS entries_checked, CAST(count(*) AS BIGINT) AS signed, CAST(0 AS BIGINT) AS unsigned FROM events GROUP BY 1")
def stored_ledger_verified(spark, sf_dir):
    """Three writers append a third of the events each to one stored ledger, in turn."""
    book = stored_ledger.StoredLedger(spark, scratch(spark, "ledger"), key=b"key", groups=4)
    rows = _entries(spark, sf_dir)
    for k in range(3):
        book.append(rows.where(F.pmod("write_seq", F.lit(3)) == k))
    return book.verify(True).select("tenant_id", "intact", "entries_checked", "signed", "unsigned")


@query("""WITH t AS (SELECT unnest(range(4)) AS tick), u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT DISTINCT user_id, event_id % 4 AS tick FROM events WHERE event_type = 'error' AND value > 100),
g AS (SELECT u.user_id, t.tick, f.user_id IS NOT NULL AS holds FROM u CROSS JOIN t LEFT JOIN f ON f.user_id = u.user_id AND f.tick = t.tick),
h AS (SELECT *, coalesce(lag(holds) OVER (PARTITION BY user_id ORDER BY tick), FALSE) AS held, lead(tick) OVER (PARTITION BY user_id ORDER BY tick) IS NOT NULL AS more FROM g),
r AS (SELECT h.user_id, h.tick, EXISTS (SELECT 1 FROM g x WHERE x.user_id = h.user_id AND x.tick > h.tick AND NOT x.holds) AS cleared FROM h WHERE holds AND NOT held)
SELECT 'user ' || user_id AS key, 'user ' || user_id || '#' || tick AS alert_id, cleared, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 5 END::BIGINT AS tries, user_id % 2 = 0 AS delivered FROM r""")
def alert_states(spark, sf_dir):
    """Four ticks, each over a quarter of the events, raise an alert for users with a large error; the receiver of odd users never answers."""
    book = alerts.AlertBook(spark, scratch(spark, "alerts"))
    e = table(spark, sf_dir, "events").where("event_type = 'error' AND value > 100")
    noon = datetime(2024, 2, 1, 12)
    for number in range(4):
        found = e.where(F.pmod("event_id", F.lit(4)) == number).select(F.format_string("user %d", "user_id").alias("key"), F.lit("large error").alias("kind"), F.lit("a large error").alias("message"), F.lit("{}").alias("payload"))
        book.tick(found, number, noon + timedelta(minutes=number))
    for hour in range(1, 8):
        book.deliver(lambda m: "no answer" if int(m["alert_id"].split("#")[0][5:]) % 2 else None, noon + timedelta(hours=hour), b"secret")
    return book.states().select("key", "alert_id", "cleared", "tries", "delivered")


#: A small frozen ensemble: three trees over a part's size and price.
TREES = {
    "feature": np.array([[0, 1, -1, -1, -1], [1, -1, 0, -1, -1], [0, -1, -1, -1, -1]]), "threshold": np.array([[25.0, 1200.5, 0, 0, 0], [1450.25, 0, 10.0, 0, 0], [40.0, 0, 0, 0, 0]]),
    "left": np.array([[1, 3, 0, 0, 0], [1, 0, 3, 0, 0], [1, 0, 0, 0, 0]]), "right": np.array([[2, 4, 0, 0, 0], [2, 0, 4, 0, 0], [2, 0, 0, 0, 0]]),
    "value": np.array([[0, 0, 0.75, -0.5, 0.25], [0, -0.25, 0, 1.0, -1.0], [0, 0.125, -0.375, 0, 0]]),
}


@query("""WITH t AS (SELECT p_partkey, CAST(p_size AS FLOAT) AS s, CAST(p_retailprice AS FLOAT) AS p FROM part), r AS (SELECT p_partkey, -0.25 + 0.5 * CASE WHEN s <= 25.0 THEN CASE WHEN p <= 1200.5 THEN -0.5 ELSE 0.25 END ELSE 0.75 END
+ 0.5 * CASE WHEN p <= 1450.25 THEN -0.25 WHEN s <= 10.0 THEN 1.0 ELSE -1.0 END + 0.5 * CASE WHEN s <= 40.0 THEN 0.125 ELSE -0.375 END AS raw FROM t) SELECT p_partkey, round(1 / (1 + exp(-CAST(raw AS DOUBLE))), 6) AS probability FROM r""")
def tree_scores(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", r6(models.score_trees(TREES, -0.25, 0.5, [F.col("p_size"), F.col("p_retailprice")])).alias("probability"))


_EPOCH = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"


def _diary(spark, sf_dir):
    """Users' office hours on the days that they have an event, and half an hour taken by each event; seconds of the year."""
    at = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), F.expr(_EPOCH).cast("long").alias("start"), "event_id", "event_type")
    day = F.col("start") - F.pmod("start", F.lit(86_400))
    hours = at.select("owner", (day + 8 * 3600).alias("start"), (day + 18 * 3600).alias("end")).distinct()
    return at, hours, at.select("owner", "start", (F.col("start") + 1800).alias("end"))


_DIARY = """a AS (SELECT user_id AS owner, datediff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts)) AS s, event_id, event_type FROM events), h AS (SELECT DISTINCT owner, s - s % 86400 + 28800 AS s, s - s % 86400 + 64800 AS e FROM a),
b AS (SELECT DISTINCT owner, s, s + 1800 AS e FROM a), x AS (SELECT h.owner, h.s AS hs, h.e AS he, greatest(b.s, h.s) AS s, least(b.e, h.e) AS e FROM h JOIN b ON b.owner = h.owner AND b.s < h.e AND b.e > h.s),
y AS (SELECT *, coalesce(max(e) OVER (PARTITION BY owner, hs ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hs) AS upto FROM x),
f AS (SELECT owner, upto AS s, s AS e FROM y WHERE s > upto UNION ALL SELECT owner, max(e), any_value(he) FROM x GROUP BY owner, hs HAVING max(e) < any_value(he) UNION ALL SELECT owner, s, e FROM h WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.owner = h.owner AND x.hs = h.s))"""


@query(f"WITH {_DIARY} SELECT owner, s AS start, e AS \"end\" FROM f")
def free_time(spark, sf_dir):
    _, hours, busy = _diary(spark, sf_dir)
    return calendar.free(hours, busy)


@query(f"""WITH {_DIARY}, c AS (SELECT owner, s + 3600 * unnest(range((e - s) // 3600)) AS s FROM f), k AS (SELECT owner, s, row_number() OVER (PARTITION BY owner ORDER BY s) AS k FROM c),
r AS (SELECT owner, event_id AS request, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS priority FROM a), q AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY priority, request) AS k FROM r)
SELECT q.owner, request, priority, s AS start, s + 3600 AS "end" FROM q LEFT JOIN k ON k.owner = q.owner AND k.k = q.k""")
def slot_assignment(spark, sf_dir):
    """Each event asks for an hour of its user's free time, errors first."""
    at, hours, busy = _diary(spark, sf_dir)
    asked = at.select("owner", F.col("event_id").alias("request"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("priority"))
    return calendar.assign(asked, calendar.slots(calendar.free(hours, busy), 3600))


@query()
def stream_guard(spark, sf_dir):
    """A canary for users of odd numbers, judged every 25 impressions against the others."""
    e = streams.read_stream(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)
    live = F.col("user_id") % 2 == 0
    outcomes = e.select(
        F.lit("ranker").alias("name"), F.when(live, "live").otherwise("canary").alias("arm"), F.lit(2).alias("version"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("request_id"),
        (F.col("event_type") == "click").alias("clicked"), (F.col("value") / 500).alias("probability"), F.col("value").alias("latency_ms"), F.lit(False).alias("is_credit"),
    )
    return guard.drained(outcomes)


@query("SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'signup')")
def current_epoch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return streams.current_epoch(e, e.where("event_type = 'signup'"), "event_id").select("event_id")

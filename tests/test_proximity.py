"""Proximity graphs and stored indexes against exact neighbours."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpforge.operators import blocks, proximity, retrieval
from kelpforge.operators.stored_index import StoredIndex
from kelpforge.sources import files, shared

SCHEMA = "id long, vector array<double>"


def plain(rows, queries, k):
    """The k nearest keys of each query, by plain loops."""
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    return {q: [i for _, i in sorted((-round(float(unit(v) @ unit(w)), 9), i) for i, w in rows)[:k]] for q, v in queries}


def recall(found, rows, queries, k):
    want, got = plain(rows, queries, k), {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["item_id"])
    return np.mean([len(got.get(q, set()) & set(w)) / len(w) for q, w in want.items()])


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 2
    return [(i, (centres[i % 12] + rng.normal(size=16)).tolist()) for i in range(1200)]


@pytest.fixture(scope="module")
def graph(spark, clustered):
    return proximity.build_graph(spark.createDataFrame(clustered, SCHEMA))


def test_links_are_near_and_bounded(graph, clustered):
    degree = proximity.GraphConfig().degree
    links = graph.links.collect()
    sizes = {}
    for r in links:
        sizes[r["id"]] = sizes.get(r["id"], 0) + 1
    assert len(sizes) == 1200 and max(sizes.values()) <= 2 * degree and all(r["id"] != r["other"] for r in links)
    want = plain(clustered, clustered[::40], degree + 1)
    held = {q: {r["other"] for r in links if r["id"] == q} for q in want}
    assert np.mean([len(held[q] & set(w[: degree // 2 + 1])) / (degree // 2) for q, w in want.items()]) > 0.9


def test_recall_grows_with_the_budget(spark, graph, clustered):
    queries = clustered[::60]
    asked = spark.createDataFrame(queries, SCHEMA)
    told = {r["budget"]: r["recall"] for r in proximity.recall_by_budget(asked, graph, blocks.block_top_k(asked, spark.createDataFrame(clustered, SCHEMA), 10, unit=True), 10, (10, 40, 120)).collect()}
    assert told[10] <= told[120] and told[120] >= 0.95
    assert recall(proximity.graph_neighbours(asked, graph, 10, 120), clustered, queries, 10) == pytest.approx(told[120])


def test_odd_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(200)] + [(k, [0.0, 1.0]) for k in range(200, 210)] + [(300, [0.0, 0.0]), (301, None), (None, [1.0, 1.0]), (5, [1.0, 0.0])]
    graph = proximity.build_graph(spark.createDataFrame(rows, SCHEMA), proximity.GraphConfig(degree=4, leaf_rows=8))
    assert graph.nodes.count() == 211
    found = proximity.graph_neighbours(spark.createDataFrame([(1, [0.0, 3.0]), (2, None)], SCHEMA), graph, 5, 40).collect()
    assert {r["query_id"] for r in found} == {1} and {r["item_id"] for r in found} <= set(range(200, 210)) and len(found) == 5
    empty = proximity.build_graph(spark.createDataFrame([], SCHEMA))
    assert proximity.graph_neighbours(spark.createDataFrame([(1, [0.0, 3.0])], SCHEMA), empty, 5).collect() == []


def test_a_stored_index_follows_changes_without_a_rebuild(spark, clustered, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"), proximity.GraphConfig(degree=8))
    queries = clustered[::100]
    asked = spark.createDataFrame(queries, SCHEMA)
    assert index.search(asked, 3).collect() == [] and index.compact() == 0
    standing = dict(clustered[:800])
    assert index.put(spark.createDataFrame(clustered[:800], SCHEMA)) == 1 and index.compact() == 1
    built = shared.names_in(spark, index.folder)
    moved = [(i, [-x for x in v]) for i, v in clustered[:40]]
    index.put(spark.createDataFrame(clustered[800:] + moved, SCHEMA))
    index.withdraw(spark.createDataFrame([(100,), (101,), (5000,)], "id long"))
    index.put(spark.createDataFrame([(101, clustered[101][1])], SCHEMA))
    standing |= dict(clustered[800:]) | dict(moved)
    del standing[100]
    assert shared.names_in(spark, index.folder) == built  # nothing was built again
    assert recall(index.search(asked, 10, 96), list(standing.items()), queries, 10) >= 0.95
    assert not {r["item_id"] for r in index.search(asked, 10, 96).collect()} & {100}
    assert {r["id"] for r in index.live().collect()} == set(standing)
    assert index.compact() == 4 and index.compact() == 4
    again = StoredIndex(spark, index.folder)
    assert recall(again.search(asked, 10, 96), list(standing.items()), queries, 10) >= 0.95
    assert again.clean() and again.base().nodes.count() == len(standing)
    assert again.put(spark.createDataFrame([(9000, queries[0][1])], SCHEMA)) == 5
    assert 9000 in {r["item_id"] for r in again.search(asked.limit(1), 2).collect()}


def test_a_half_written_base_is_never_read(spark, clustered, tmp_path, monkeypatch):
    index = StoredIndex(spark, str(tmp_path / "index"), proximity.GraphConfig(degree=4, rounds=1))
    index.put(spark.createDataFrame(clustered[:100], SCHEMA))
    index.compact()
    index.put(spark.createDataFrame([(7777, clustered[3][1])], SCHEMA))
    from kelpforge.operators import stored_index

    def fails(*_):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(stored_index, "create_once", fails)
        index.compact()
    again = StoredIndex(spark, index.folder)
    assert again.version() == 1 and 7777 in {r["id"] for r in again.live().collect()}
    assert again.compact() == 2 and 7777 in {r["id"] for r in again.base().nodes.collect()}
    assert len([n for n in again.clean() if n.startswith("base-")]) == 3  # two folders and the older mark


def test_open_batches_wait_and_may_be_given_up(spark, clustered, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"), proximity.GraphConfig(degree=4, rounds=0))
    index.put(spark.createDataFrame(clustered[:50], SCHEMA))
    left = index._claim()
    later = index.put(spark.createDataFrame(clustered[50:60], SCHEMA))
    assert (left, later) == (2, 3) and index.compact() == 1
    assert index.live().count() == 60
    assert index.give_up(left) and not index.give_up(left) and not index.give_up(later)
    assert index.compact() == 3 and index.base().nodes.count() == 60


def test_only_one_writer_creates_a_file(spark, tmp_path):
    won, path = [], str(tmp_path / "a" / "claim")
    threads = [threading.Thread(target=lambda k=k: won.append(k) if shared.create_once(spark, path, str(k)) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and shared.read_small(spark, path) == str(won[0])
    assert shared.names_in(spark, str(tmp_path / "a")) == ["claim"]


def test_a_failed_build_is_built_again(spark, tmp_path):
    store = files.StateStore(spark, str(tmp_path / "state"))
    spark.range(3).write.parquet(store.path("built-abc-left"))
    built = []

    def build(fail):
        built.append(fail)
        return spark.range(5).select(F.when(F.lit(fail) & (F.col("id") > 2), F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))

    with pytest.raises(Exception, match="lost"):
        store.restore_or_build("abc", lambda: build(True))
    assert store.restore_or_build("abc", lambda: build(False)).count() == 5
    assert store.restore_or_build("abc", lambda: build(False)).count() == 5 and built == [True, False]


def test_withdrawn_live_version_is_replaced_by_the_newest_archived(spark):
    from kelpforge.operators import governance

    def told(*rows):
        events = spark.createDataFrame([("m", v, k, stage) for k, (v, stage) in enumerate(rows)], "name string, version int, seq int, stage string")
        return {r.version: r.stage for r in governance.current_stages(events).collect()}

    assert told((1, "LIVE"), (2, "LIVE"), (3, "LIVE"), (3, "ROLLED_BACK")) == {1: "ARCHIVED", 2: "LIVE", 3: "ROLLED_BACK"}
    assert told((1, "LIVE"), (2, "LIVE"), (1, "ROLLED_BACK")) == {1: "ROLLED_BACK", 2: "LIVE"}
    assert told((1, "LIVE"), (1, "ARCHIVED")) == {1: "ARCHIVED"}


def test_many_neighbourhoods_in_one_call_equal_each_alone():
    import numpy as np
    import pandas as pd

    from kelpforge.operators import proximity

    rng = np.random.default_rng(1)
    rows = pd.DataFrame([(g, int(i), rng.integers(-2, 3, 4).astype(float), bool(rng.random() < 0.4)) for g in range(9) for i in rng.choice(50, 12, replace=False)], columns=["id", "other", "vector", "fresh"])
    one = proximity._by_group(["id"], proximity._near_in_group(5, True))
    alone = pd.concat([one(r) for _, r in rows.groupby("id")], ignore_index=True)
    pd.testing.assert_frame_equal(one(rows.sample(frac=1, random_state=2)), alone)

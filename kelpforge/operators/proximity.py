"""Approximate nearest neighbours by a proximity graph that is a table, built and searched by joins.

Nodes are (id, vector), unit vectors under cosine; links are (id, other, similarity), `degree` a node. Building starts from
small random-projection leaves and goes on in rounds of NN-descent: what a node's neighbours (both ways) have near them
becomes a candidate for each other. A group is one node's neighbourhood, of a bounded size, so rounds are joins and
grouped maps with no graph in any one task. Searching is a best-first walk for all queries and budgets at once: each step
joins the best open nodes of every query with the links and their vectors, and keeps the best `budget` seen.

The links are pruned as they are stored: a link to a node that lies nearer to a kept neighbour than to the node itself goes to
the end of the list, so that links lead in different directions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpforge.functions.numeric import dot, normalised
from kelpforge.operators.blocks import block_top_k
from kelpforge.sources.shared import settle

#: Rows of a random-projection leaf at most, about; and of the levels that a tree may have.
LEAF_ROWS, MOST_LEVELS = 64, 40
#: Nodes that queries may start from, at least; there are as many as the root of the nodes' number.
ENTRIES = 64
#: Small groups (neighbourhoods, leaves) that a task works out in one go.
GROUPS_AT_ONCE = 256


@dataclass(frozen=True)
class GraphConfig:
    degree: int = 16
    trees: int = 4
    rounds: int = 3
    seed: int = 7
    leaf_rows: int = LEAF_ROWS

    def __post_init__(self):
        if min(self.degree, self.trees, self.leaf_rows) < 1 or self.rounds < 0:
            raise ValueError("a graph needs links and leaves")


@dataclass
class Graph:
    """nodes (id, vector), links (id, other, similarity), entries (id, vector)."""

    nodes: DataFrame
    links: DataFrame
    entries: DataFrame


def unit_nodes(corpus: DataFrame) -> DataFrame:
    """id, vector of length one as array<float>; null vectors take no part, of equal ids the vector counts that sorts first."""
    own = corpus.where("vector IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    return own.select("id", F.transform(normalised(F.col("vector")), lambda x: x.cast("float")).alias("vector"))


def _leaves(nodes: DataFrame, tree: int, levels: int, config: GraphConfig, width: int) -> DataFrame:
    """leaf, id, vector: nodes by the signs of as many random projections as there are levels, dealt by hash where vectors crowd."""
    planes = np.random.default_rng([config.seed, tree]).normal(size=(max(levels, 1), max(width, 1)))

    @F.pandas_udf("long")
    def code(v: pd.Series) -> pd.Series:
        m = np.array([np.asarray(x, np.float64) for x in v]) if len(v) else np.zeros((0, width))
        return pd.Series(((m @ planes.T > 0) @ (1 << np.arange(len(planes), dtype=np.int64))) if len(v) else [], dtype="int64")

    coded = nodes.select(code("vector").alias("code"), "id", "vector")
    crowd = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).withColumn("deals", F.ceil(F.col("n") / config.leaf_rows).cast("int"))
    return coded.join(crowd, "code").select("code", F.pmod(F.xxhash64("id", F.lit(tree)), F.col("deals")).alias("deal"), "id", "vector")


def _by_group(keys: list[str], each):
    """A grouped map over many small groups at once: each(rows, vectors, slice) for every group by keys.

    A group for itself would cost more to hand over than to work out.
    """

    def groups(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*keys, "other"], kind="stable")
        m = np.array([np.asarray(v, np.float64) for v in rows["vector"]])
        starts = np.zeros(len(rows), bool)
        starts[0] = True
        for c in keys:
            own = rows[c].to_numpy()
            starts[1:] |= own[1:] != own[:-1]
        cuts = np.flatnonzero(starts)
        found = [each(rows, m, slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("id", "other", "similarity"))})

    return groups


def _at_once(rows: DataFrame, keys: list[str], groups: int, each, schema: str) -> DataFrame:
    """each for all of about so many groups by keys, GROUPS_AT_ONCE to a call."""
    deal = F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(max(1, -(-groups // GROUPS_AT_ONCE)))).alias("dealt")
    return rows.groupBy(deal).applyInPandas(_by_group(keys, each), schema)


def _near_in_group(degree: int, fresh: bool):
    """Of the pairs of a small group's rows each row's `degree` best; with fresh, only pairs one of which is new."""

    def pairs(rows: pd.DataFrame, m: np.ndarray, own: slice) -> tuple:
        ids = rows["other"].to_numpy()[own]
        once = np.r_[True, ids[1:] != ids[:-1]]
        ids, v = ids[once], m[own][once]
        s = np.round(v @ v.T, 9)
        np.fill_diagonal(s, -np.inf)
        if fresh:
            new = rows["fresh"].to_numpy(bool)[own][once]
            s[~(new[:, None] | new[None, :])] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :degree]
        told = np.take_along_axis(s, top, 1).ravel()
        some = np.isfinite(told)
        return np.repeat(ids, top.shape[1])[some], ids[top].ravel()[some], told[some]

    return pairs


def _best_links(pairs: DataFrame, degree: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= degree)


def build_graph(corpus: DataFrame, config: GraphConfig | None = None) -> Graph:
    """The graph of corpus (id, vector). An empty corpus gives an empty graph.

    A round costs a shuffle of at most 2 * degree vectors a node. Rounds end early once fewer than one link in a hundred
    is new.
    """
    config = config or GraphConfig()
    nodes = settle(unit_nodes(corpus))
    kind, n = dict(nodes.dtypes)["id"], nodes.count()
    first = nodes.first()
    width = len(first["vector"]) if first else 1
    links_type = f"id {kind}, other {kind}, similarity double"
    levels = min(MOST_LEVELS, max(0, (n // config.leaf_rows).bit_length()))
    found = None
    for tree in range(config.trees):
        leaves = _leaves(nodes, tree, levels, config, width).select("code", "deal", F.col("id").alias("other"), "vector", F.lit(True).alias("fresh"))
        near = _at_once(leaves, ["code", "deal"], n // config.leaf_rows + 1, _near_in_group(config.degree, False), links_type)
        found = near if found is None else found.union(near)
    links = settle(_best_links(found.groupBy("id", "other").agg(F.max("similarity").alias("similarity")), config.degree).withColumn("fresh", F.lit(True)))
    for _ in range(config.rounds if n else 0):
        back = _best_links(links.select(F.col("other").alias("id"), F.col("id").alias("other"), "similarity", "fresh"), config.degree)
        around = links.select("id", "other", "fresh").union(back.select("id", "other", "fresh")).groupBy("id", "other").agg(F.max("fresh").alias("fresh"))
        around = around.union(nodes.select("id", F.col("id").alias("other"), F.lit(False)))  # the node itself meets its neighbours' neighbours through them
        met = around.join(nodes.select(F.col("id").alias("other"), "vector"), "other")
        near = _at_once(met, ["id"], n, _near_in_group(config.degree, True), links_type)
        both = links.select("id", "other", "similarity", F.lit(False).alias("fresh")).union(near.select("*", F.lit(True)))
        both = both.groupBy("id", "other").agg(F.max("similarity").alias("similarity"), F.min("fresh").alias("fresh"))
        links = settle(_best_links(both, config.degree))
        if links.where("fresh").count() * 100 < n * config.degree:
            break
    kept = links.select("id", "other", "similarity")
    return Graph(nodes, settle(spread(kept, nodes, config.degree, n)), entry_nodes(nodes, n))


def spread(links: DataFrame, nodes: DataFrame, degree: int, n: int | None = None) -> DataFrame:
    """links and those that lead back, at most 2 * degree a node: first what no kept neighbour lies nearer to, then the rest by similarity."""
    kind = dict(nodes.dtypes)["id"]
    both = links.union(links.select(F.col("other").alias("id"), F.col("id").alias("other"), "similarity")).distinct()
    near = _best_links(both, 4 * degree).join(nodes.select(F.col("id").alias("other"), "vector"), "other").select("id", "other", "similarity", "vector")

    def choose(rows: pd.DataFrame, m: np.ndarray, own: slice) -> tuple:
        near, other = rows["similarity"].to_numpy()[own], rows["other"].to_numpy()[own]
        order = np.argsort(-near, kind="stable")  # others lie in order, so equals go by id
        near, other, v, chosen = near[order], other[order], m[own][order], []
        s = np.round(v @ v.T, 9)
        for j in range(len(near)):
            if not chosen or s[j, chosen].max() < near[j]:
                chosen.append(j)
        taken = (chosen + sorted(set(range(len(near))) - set(chosen)))[: 2 * degree]
        return rows["id"].to_numpy()[own][: len(taken)], other[taken], near[taken]

    return _at_once(near, ["id"], nodes.count() if n is None else n, choose, f"id {kind}, other {kind}, similarity double")


def entry_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """The nodes with the smallest hashes: a random few of the n, always the same."""
    return settle(nodes.orderBy(F.xxhash64("id"), "id").limit(max(ENTRIES, int(n**0.5))))


def _likeness(a: str, b: str) -> Column:
    return F.round(dot(F.col(a), F.col(b)), 9)


def walk(queries: DataFrame, graph: Graph, k: int, budgets: tuple[int, ...] = (64,), starts: int = 4, at_once: int = 16, gone: DataFrame | None = None, most_steps: int = 200) -> DataFrame:
    """budget, query_id, item_id, similarity, rank: about the k nearest nodes to each query (id, vector), for each search budget.

    A query keeps the `budget` best nodes met and opens its `at_once` best unopened ones each step, until none of those it
    keeps is unopened. All budgets walk together, so a step is one set of joins whatever their number. gone (id) names nodes
    that lead on but are no answers. An empty graph gives no rows.
    """
    asked = settle(unit_nodes(queries).select(F.col("id").alias("query_id"), F.col("vector").alias("asked")))
    # The few entries are one block; each query takes its best of them.
    seeds = block_top_k(asked.select(F.col("query_id").alias("id"), F.col("asked").alias("vector")), graph.entries.select("id", "vector"), starts, decimals=9)
    budget = F.explode(F.array(*map(F.lit, budgets))).alias("budget")
    state = settle(seeds.select(budget, "query_id", F.col("item_id").alias("node"), F.col("score").alias("similarity"), F.lit(False).alias("opened")))
    own = ["budget", "query_id"]
    order = Window.partitionBy(*own).orderBy(F.desc("similarity"), "node")
    for _ in range(most_steps):
        turn = F.row_number().over(Window.partitionBy(*own).orderBy("opened", F.desc("similarity"), "node"))
        state = state.withColumn("turn", turn)
        opening = state.where(~F.col("opened") & (F.col("turn") <= at_once)).select(*own, "node")
        if opening.isEmpty():
            break
        steps = opening.join(graph.links.select(F.col("id").alias("node"), "other"), "node").select(*own, F.col("other").alias("node")).distinct()
        steps = steps.join(state.select(*own, "node"), [*own, "node"], "left_anti")
        new = steps.join(graph.nodes.select(F.col("id").alias("node"), "vector"), "node").join(asked, "query_id").select(*own, "node", _likeness("vector", "asked").alias("similarity"), F.lit(False).alias("opened"))
        moved = state.select(*own, "node", "similarity", (F.col("opened") | (F.col("turn") <= at_once)).alias("opened"))
        # Nodes beyond the budget are forgotten: they can't come back, for what they are liker than stays.
        state = settle(moved.union(new).withColumn("place", F.row_number().over(order)).where("place <= budget").drop("place"))
    held = state.drop("turn") if "turn" in state.columns else state
    if gone is not None:
        held = held.join(gone.select(F.col("id").alias("node")).distinct(), "node", "left_anti")
    ranked = held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("budget", "query_id", F.col("node").alias("item_id"), "similarity", "rank")


def graph_neighbours(queries: DataFrame, graph: Graph, k: int, budget: int = 64, gone: DataFrame | None = None) -> DataFrame:
    """query_id, item_id, similarity, rank: about the k nearest nodes to each query."""
    return walk(queries, graph, k, (budget,), gone=gone).drop("budget")


def recall_by_budget(queries: DataFrame, graph: Graph, exact: DataFrame, k: int, budgets: tuple[int, ...] = (16, 32, 64, 128)) -> DataFrame:
    """budget, recall: share of the exact neighbours (query_id, item_id) that the graph finds within each search budget."""
    found = walk(queries, graph, k, budgets).select("budget", "query_id", "item_id", F.lit(1).alias("hit"))
    wanted = exact.select("query_id", "item_id").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return wanted.join(found, ["budget", "query_id", "item_id"], "left").groupBy("budget").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))

"""Clustering matched pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import write_through

#: Pairs numbered within 2^20 of each other form one chunk, which bounds every sorted window.
CHUNK_BITS = 20


def node(side: str | Column, index: str) -> Column:
    """Ids of the two sources live in one graph, so they carry their side."""
    return F.concat(side if isinstance(side, Column) else F.lit(side), F.lit(":"), F.col(index))


def match_edges(pairs: DataFrame) -> DataFrame:
    """Graph edges (u, v) of class pairs."""
    return pairs.select(node("a", "rep1").alias("u"), node("b", "rep2").alias("v"))


def _state(edges: DataFrame) -> tuple:
    """Count and checksum: equal before and after a round exactly when nothing changed."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node it sees."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("low")
    )
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Needs u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = (
        edges.join(least, "u")
        .filter("v <> low")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
    )
    return moved.unionAll(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, cluster_id) for every node of the edges (u, v); cluster_id is the smallest id.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). A round is a handful of
    joins; its edges are written out, so the plan stays short however many rounds it takes. Only a
    count and a checksum reach the driver.
    """
    edges = write_through(
        edges.filter("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = _state(edges)
    while True:
        edges = write_through(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    linked = edges.select(F.col("u").alias("id"), F.col("v").alias("cluster_id"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("cluster_id")).distinct()
    return linked.unionAll(roots)


def components(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters of records, (cluster_id, id), from class pairs and the records of each class.

    The graph has one node per class; its records are attached afterwards.
    """
    roots = connected_components(match_edges(pairs)).withColumnRenamed("id", "rep")
    named = members.select(
        node(F.col("side"), "rep").alias("rep"), node(F.col("side"), "index").alias("id")
    )
    return named.join(roots, "rep").select("cluster_id", "id")


def _earlier_minimum(touches: DataFrame) -> DataFrame:
    """For every (node, seq): the least label among this and earlier pairs of the node.

    A running minimum in two levels, so that no sorted group grows with the node's degree: inside
    chunks of at most 2^20 consecutive pairs, and over the minima of a node's chunks.
    """
    inside = Window.partitionBy("node", "chunk").orderBy("seq")
    across = Window.partitionBy("node").orderBy("chunk")
    touches = touches.withColumn("chunk", F.shiftright("seq", CHUNK_BITS))
    carried = (
        touches.groupBy("node", "chunk")
        .agg(F.min("label").alias("low"))
        .withColumn(
            "before", F.min("low").over(across.rowsBetween(Window.unboundedPreceding, -1))
        )
        .select("node", "chunk", "before")
    )
    running = F.min("label").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        touches.withColumn("running", running)
        .join(carried, ["node", "chunk"])
        .select("node", "seq", F.least("running", "before").alias("label"))
    )


def first_fit(pairs: DataFrame, order: Sequence[str] = ("id1", "id2")) -> DataFrame:
    """Clusters, (cluster_id, id), of pairs that join the first cluster sharing one of their ids.

    Pairs are taken in ``order``, which must be unique. A pair joins the oldest cluster that holds
    one of its ids, else it founds one; clusters never merge and may overlap. Names a cluster after
    its founding pair.

    Without a sequential loop: number the pairs. After a pair, both its ids are in its cluster, so a
    pair's cluster is the smallest number among itself and the clusters of the earlier pairs of its
    two ids. Labels start as the pair's own number and fall until nothing changes; following a label to
    that pair's own label keeps the rounds few on long chains.
    """
    numbered = write_through(
        pairs.select("id1", "id2", *[c for c in order if c not in ("id1", "id2")])
        .orderBy(*order)
        .select("id1", "id2", F.monotonically_increasing_id().alias("seq"))
    )
    touches = numbered.select(
        "seq", F.explode(F.array_distinct(F.array("id1", "id2"))).alias("node")
    )
    labels = numbered.select("seq", F.col("seq").alias("label"))
    while True:
        lowered = (
            _earlier_minimum(touches.join(labels, "seq"))
            .groupBy("seq")
            .agg(F.min("label").alias("label"))
        )
        lowered = write_through(lowered)
        ahead = lowered.select(F.col("seq").alias("label"), F.col("label").alias("next"))
        moved = write_through(lowered.join(ahead, "label").select("seq", F.col("next").alias("label")))
        changed = moved.join(labels.withColumnRenamed("label", "old"), "seq").filter("label <> old")
        labels = moved
        if changed.isEmpty():
            break
    held = touches.join(labels, "seq").select("label", "node").distinct()
    founders = numbered.select(F.col("seq").alias("label"), F.concat_ws("|", "id1", "id2").alias("cluster_id"))
    return held.join(founders, "label").select("cluster_id", F.col("node").alias("id"))


def cluster_count(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.countDistinct("cluster_id").alias("clusters"))


def first_fit_members(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """First-fit clusters of class pairs with all their records, (cluster_id, id).

    Record pairs are taken in the order of their classes: by the smallest ids of both classes, and inside
    a pair of classes by the records' own ids. A copy meets exactly the pairs of its class, so it lies in every
    cluster that its class's representative lies in, and names are those of the representatives, which come first.
    """
    named = members.select(node(F.col("side"), "rep").alias("rep"), node(F.col("side"), "index").alias("id"))
    return clusters.withColumnRenamed("id", "rep").join(named, "rep").select("cluster_id", "id").distinct()


def resolved_records(records: DataFrame, clusters: DataFrame) -> DataFrame:
    """One record per entity: every unmatched record and the namesake of every cluster.

    ``records`` carry the cluster ids in ``id``.
    """
    absorbed = clusters.filter("id <> cluster_id").select("id")
    return records.join(absorbed, "id", "left_anti")

"""Connected components of a link table: the distributed union-find of the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.shared import forget, saved

#: A path of n links needs about log2(n) rounds; the rounds end as soon as nothing changes.
MAX_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that occurs in links: component is the smallest node that is
    reachable. Self-links, repeated links and either direction are allowed, null ends are left out.

    Each round gives a node the smallest label among its neighbours, then the label of that label. Joins
    have one row for each key on one side, so a node with very many links can be split; nothing is
    collected. Every round is a written table, so lost executors don't lose it.
    """
    ends = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = saved(ends.union(ends.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = saved(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.lit(-1).cast("long").alias("was"), F.least("node", "least").alias("label")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        roots = hooked.select(F.col("node").alias("label"), F.col("label").alias("root"))
        following = saved(hooked.join(roots, "label").select("node", "was", F.least("label", "root").alias("label")), "labels")
        forget(labels)
        labels = following
        if labels.filter("label <> was").isEmpty():
            forget(both)
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """What components() gives for the links (a, b) behind labels(node, component) and these links together: only the
    links between components are followed, so that a link that is known already costs nothing more."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"component_{c}"))
    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    roots = components(ends.filter("a <> b").distinct()).select(F.col("node").alias("component"), F.col("component").alias("root"))
    fresh = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    every = labels.select("node", "component").union(fresh.select("node", F.col("node").alias("component")))
    return saved(every.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")

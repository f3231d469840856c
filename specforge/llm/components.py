"""Connected components of a table of links, by alternating star contractions.

A large star moves a node's larger neighbours to its smallest one, a small star
its smaller ones; both keep the components and end in stars around the smallest
nodes, after a number of rounds that grows with the logarithm of the size.  Every
round is written to the shared folder.  The largest stars join one row per hub
with many links, which adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specforge.llm.common import stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links as (larger, smaller)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionAll(rest).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link.

    `links` has two columns of comparable ids; loops, repeats and either order are
    fine, rows with a null are not links.
    """
    a, b = links.columns
    edges = stored(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
        edges = stored(_small(_large(edges)))
    centers = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(centers)


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as the given ones: each node to its smallest."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[:len(left)], at[len(left):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]

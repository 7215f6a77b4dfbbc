"""Drill-down into one super-node.

The cluster id becomes a predicate on the event table (pushed into the Parquet
scan of a stored session: ``startswith`` and equality push down, ``rlike`` does
not), the full graph pipeline runs on the matching subset, and the 75 most
relevant nodes are kept with the edges among them. The top-k is a
``TakeOrderedAndProject`` (each task keeps k rows), and the kept-id list that
filters the edges is bounded by k, so broadcasting it is safe.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loggraph import constants as K
from loggraph.functions.net import is_private
from loggraph.operators.graph import Graph, attach_users, build_graph
from loggraph.session import drop_table, materialize

#: Largest k of the top-k: its ids are broadcast.
BROADCAST_NODES = 10_000


@dataclass
class Expansion:
    parent: str
    nodes: DataFrame
    edges: DataFrame
    total_nodes: DataFrame   # one row: node count before the cap (for "n of m")
    graph: Graph | None = None
    kept: DataFrame | None = None

    def __enter__(self) -> "Expansion":
        return self

    def __exit__(self, *_) -> None:
        """Delete the tables written for the drill-down."""
        if self.kept is not None:
            drop_table(self.kept)
        if self.graph is not None:
            self.graph.release()


def _subnet_rows(super_id: str):
    """Rows whose source or target lies in the /24 named by the id. Used only as a
    filter: a NULL target drops the row like False would, and the bare OR of
    ``startswith`` pushes down into the Parquet scan."""
    octets = super_id[len(K.SUPER_SUBNET_PREFIX):].split("/")[0].split(".")[:3]
    start = ".".join(octets) + "."
    return F.col("source_ip").startswith(start) | F.col("target").startswith(start)


#: Pattern of a cluster id -> its rows.
CLUSTER_ROWS = [
    (re.compile(f"{re.escape(K.SUPER_EXTERNAL_THREATS)}|{re.escape(K.SUPER_EXTERNAL_NOISE)}"),
     lambda _: ~is_private(F.col("source_ip"))),
    (re.compile(f"{re.escape(K.SUPER_WEB_URLS)}|{re.escape(K.SUPER_WEB_SURFACE)}"), lambda _: F.col("protocol") == "HTTP"),
    (re.compile(re.escape(K.SUPER_INTERNAL_BASELINE)), lambda _: is_private(F.col("source_ip"))),
    (re.compile(re.escape(K.SUPER_SUBNET_PREFIX) + r".*"), _subnet_rows),
]


def cluster_predicate(super_id: str):
    """The event filter for one cluster id; ``None`` for an unknown id (E5)."""
    return next((rows(super_id) for pattern, rows in CLUSTER_ROWS if pattern.fullmatch(super_id)), None)


def top_nodes(nodes: DataFrame, edges: DataFrame, k: int = K.EXPAND_MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """K1: top-k nodes by (touches an anomalous edge, risk) desc, id asc; induced edges."""
    anom = edges.where("is_anomalous")
    touch = (anom.select(F.col("source").alias("id")).union(anom.select(F.col("target").alias("id")))
             .distinct().withColumn("touch", F.lit(True)))
    ranked = nodes.join(touch, "id", "left").withColumn("touch", F.coalesce("touch", F.lit(False)))
    kept = ranked.orderBy(F.desc("touch"), F.desc("risk_score"), F.asc("id")).limit(k).drop("touch")
    if k > BROADCAST_NODES:
        raise ValueError(f"at most {BROADCAST_NODES} nodes can be kept")
    # at most k rows, written once: nodes and edges then share one ranking pass
    kept = materialize(kept, "kept_nodes")
    ids = F.broadcast(kept.select("id"))
    kept_edges = (edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
                  .join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    return kept, kept_edges.select(*edges.columns)


def capped_view(x: "Expansion", n: int = K.CLIENT_MAX_NODES) -> DataFrame:
    """K2: the first ``n`` nodes of a drill-down in its own order, each with "n of m":
    ``shown_nodes`` of ``total_nodes``, and whether the view is ``capped``."""
    kept, _ = top_nodes(x.graph.nodes, x.graph.edges, n)
    shown, total = kept.agg(F.count(F.lit(1))).scalar(), x.total_nodes.scalar()
    return kept.withColumns({"shown_nodes": shown, "total_nodes": total, "capped": shown < total})


def expand(events: DataFrame, super_id: str, k: int = K.EXPAND_MAX_NODES) -> Expansion:
    """Rebuild the graph on the cluster's events and cap it at ``k`` nodes."""
    pred = cluster_predicate(super_id)
    subset = events.where(pred) if pred is not None else events.where(F.lit(False))
    g = build_graph(subset)
    nodes, edges = top_nodes(g.nodes, g.edges, k)
    return Expansion(parent=super_id, nodes=nodes, edges=attach_users(edges, g.edge_users),
                     total_nodes=g.nodes.agg(F.count(F.lit(1)).alias("total_nodes")), graph=g, kept=nodes)

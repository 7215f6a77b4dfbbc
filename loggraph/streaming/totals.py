"""K5: global totals after every micro-batch, by retraction, in one job.

The stored facts carry their batch, so an edge is a few versions, each valid from one
batch to the next that changes it. Everything downstream follows from intervals:

* an edge version adds itself at its first batch and is taken back at its end;
* a node is signal while a version of enough risk (or an anomalous one) touches it, which
  a running sum of +1 and -1 per node tells;
* a version meets the states of its two ends on overlapping batches, which gives the
  edge, or the collapsed pair, that the graph shows in them;
* all changes are summed per batch, and only these few rows are accumulated.

No graph is built per batch and no batch is read more than once: the work follows the
number of changes. Every running sum is over at most one row per batch and key, after a
map-side sum, so hot nodes and edges are no large groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loggraph import constants as K
from loggraph.operators import edges as E
from loggraph.operators import graph as G
from loggraph.session import materialize

LAYERS = ("external", "web", "internal")


def _running(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def edge_versions(facts: DataFrame) -> DataFrame:
    """One row per edge and batch that changed it: source, target, SSH or HTTP, weight
    (without the chain bonus), anomalous, present, from, to (null: still valid)."""
    st, n = F.col("status_code"), F.col("n")
    zero = F.lit(0).cast("long")
    added = facts.select(
        *E.EDGE_KEYS, "b", n, "n_success", "n_failure", F.when((st >= 400) & (st < 500), n).otherwise(0).alias("c4"),
        F.when(st >= 500, n).otherwise(0).alias("c5"), zero.alias("users"), zero.alias("priv"))
    # a user counts in the first batch that brings it to the edge
    users = (facts.where("user IS NOT NULL").groupBy(*E.EDGE_KEYS, "user").agg(F.min("b").alias("b"))
             .select(*E.EDGE_KEYS, "b", zero.alias("n"), zero.alias("n_success"), zero.alias("n_failure"), zero.alias("c4"),
                     zero.alias("c5"), F.lit(1).cast("long").alias("users"),
                     F.col("user").isin(K.PRIVILEGED_USERS).cast("long").alias("priv")))
    sums = ("n", "n_success", "n_failure", "c4", "c5", "users", "priv")
    per = added.unionByName(users).groupBy(*E.EDGE_KEYS, "b").agg(*[F.sum(c).alias(c) for c in sums])
    so_far = per.select(*E.EDGE_KEYS, "b", *[F.sum(c).over(_running("b", *E.EDGE_KEYS)).alias(c) for c in sums],
                        F.lead("b").over(Window.partitionBy(*E.EDGE_KEYS).orderBy("b")).alias("to"))
    counts = so_far.select(
        *E.EDGE_KEYS, F.col("b").alias("from"), "to", F.col("n").alias("total_attempts"), F.col("n_success").alias("successful_auths"),
        F.col("n_failure").alias("failed_auths"), F.col("users").alias("n_users"), (F.col("priv") > 0).alias("has_priv_user"),
        F.col("c4").alias("count_4xx"), F.col("c5").alias("count_5xx"))
    ssh = E.score_ssh_edges(counts.where("protocol = 'SSH'"), drop_baseline=False)
    http = E.score_http_edges(counts.where("protocol = 'HTTP'").withColumnsRenamed({"k2": "uri_prefix", "k3": "verb"}),
                              drop_clean_repeats=False)
    host = F.concat(F.lit("host:"), "src_ip").alias("source")
    return (ssh.select(host, F.concat(F.lit("host:"), "k2").alias("target"), F.lit("").alias("verb"), F.lit(True).alias("ssh"),
                       (~E.is_baseline()).alias("present"), F.col("risk_score").alias("weight"), F.col("is_anomalous").alias("anom"),
                       "from", "to")
            .unionByName(http.select(host, F.concat(F.lit("url:"), "uri_prefix").alias("target"), "verb", F.lit(False).alias("ssh"),
                                     (~E.is_clean_repeat()).alias("present"), F.col("risk_score").alias("weight"),
                                     F.col("is_anomalous").alias("anom"), "from", "to"))
            .where("present").drop("present"))


def with_chain(versions: DataFrame) -> DataFrame:
    """SSH versions get the chain bonus from the batch on in which their source's HTTP
    risk first passes the bound (an HTTP edge of that risk never loses it)."""
    onset = (versions.where(~F.col("ssh") & (F.col("weight") > K.CHAIN_SOURCE_RISK))
             .groupBy(F.col("source").alias("s")).agg(F.min("from").alias("onset")))
    joined = versions.join(onset, versions["source"] == onset["s"], "left")
    on = F.when(F.col("ssh"), F.col("onset"))
    bonus = F.round(F.col("weight") + K.CHAIN_RISK_BONUS, 2)
    first, last = F.col("from"), F.coalesce("to", F.lit(1 << 62))
    before = F.struct(F.col("weight").alias("weight"), first.alias("from"), F.least(last, F.coalesce(on, last)).alias("to"))
    behind = F.struct(bonus.alias("weight"), F.greatest(first, F.coalesce(on, last)).alias("from"), last.alias("to"))
    part = F.explode(F.filter(F.array(before, behind), lambda p: p["from"] < p["to"])).alias("part")
    return joined.select("source", "target", "verb", "ssh", "anom", part).select(
        "source", "target", "verb", "ssh", "anom", "part.weight", "part.from",
        F.when(F.col("part.to") < (1 << 62), F.col("part.to")).alias("to"))


def _steps(df: DataFrame, keys: list[str], *flags: tuple[str, Column]) -> DataFrame:
    """+1 at ``from`` and -1 at ``to`` of every row, per flag, summed per (keys, b)."""
    both = F.explode(F.filter(F.array(F.struct(F.col("from").alias("b"), F.lit(1).alias("d")),
                                      F.struct(F.col("to").alias("b"), F.lit(-1).alias("d"))), lambda p: p["b"].isNotNull()))
    rows = df.select(*keys, *[c.cast("long").alias(n) for n, c in flags], both.alias("step"))
    return rows.groupBy(*keys, F.col("step.b").alias("b")).agg(*[F.sum(F.col(n) * F.col("step.d")).alias(n) for n, _ in flags])


def node_states(versions: DataFrame) -> DataFrame:
    """Per node and batch that changes it: its state from there on (null: gone, else
    signal or the noise super-node), whether its risk is high, and the layer."""
    factor = F.when(F.col("ssh"), F.lit(K.DEST_RISK_FACTOR)).otherwise(F.lit(1.0))
    ends = versions.select("from", "to", "anom", F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("weight").alias("risk")),
        F.struct(F.col("target").alias("id"), (F.col("weight") * factor).alias("risk")))).alias("e")).select("from", "to", "anom", "e.*")
    per = _steps(ends, ["id"], ("any", F.lit(1)), ("sig", (F.col("risk") >= K.SIGNAL_RISK_THRESHOLD) | F.col("anom")),
                 ("high", F.round("risk", 2) >= K.SIGNAL_RISK_THRESHOLD))
    now = per.select("id", "b", *[(F.sum(c).over(_running("b", "id")) > 0).alias(c) for c in ("any", "sig", "high")])
    layer = G._layer(F.col("id"))
    supers = {"external": K.SUPER_EXTERNAL_NOISE, "web": K.SUPER_WEB_SURFACE, "internal": K.SUPER_INTERNAL_BASELINE}
    noise = F.coalesce(*[F.when(layer == name, F.lit(s)) for name, s in supers.items()])
    return now.select("id", "b", layer.alias("layer"), (F.col("sig") & F.col("high")).alias("high"),
                      F.when(F.col("sig"), F.lit("signal")).when(F.col("any"), noise).alias("state"),
                      F.lead("b").over(Window.partitionBy("id").orderBy("b")).alias("until"))


def _with_end(df: DataFrame, states: DataFrame, end: str) -> DataFrame:
    """The rows cut at the changes of one end's state; ``end`` becomes what is shown of it."""
    s = states.where("state IS NOT NULL").select(F.col("id").alias("sid"), F.col("b").alias("sb"), F.col("until").alias("su"), "state")
    far = F.lit(1 << 62)
    last, until = F.coalesce("to", far), F.coalesce("su", far)
    cut = df.join(s, (F.col(end) == F.col("sid")) & (F.col("sb") < last) & (F.col("from") < until))
    keep = [c for c in df.columns if c not in (end, "from", "to", "collapsed")]
    shown = F.when(F.col("state") == "signal", F.col(end)).otherwise(F.col("state"))
    was = F.col("collapsed") if "collapsed" in df.columns else F.lit(False)
    to = F.least(last, until)
    return cut.select(*keep, shown.alias(end), F.greatest("from", "sb").alias("from"), F.when(to < far, to).alias("to"),
                      (was | (F.col("state") != "signal")).alias("collapsed"))


def totals_by_batch(facts: DataFrame, batches: DataFrame) -> DataFrame:
    """Totals of the graph after each of ``batches`` (one column ``b``) from batch-tagged facts."""
    # each read several times: written once
    versions = materialize(with_chain(materialize(edge_versions(facts), "edge_versions")), "chained_versions")
    states = materialize(node_states(versions), "node_states")
    before = Window.partitionBy("id").orderBy("b")
    was, was_high = F.lag("state").over(before), F.coalesce(F.lag("high").over(before), F.lit(False))

    def turned(now: Column, then: Column) -> Column:
        return F.coalesce(now, F.lit(False)).cast("long") - F.coalesce(then, F.lit(False)).cast("long")

    of_nodes = states.select(
        "b", turned(F.col("state") == "signal", was == "signal").alias("signal"), turned(F.col("high"), was_high).alias("high"),
        *[turned((F.col("layer") == x) & (F.col("state") != "signal"), (F.col("layer") == x) & (was != "signal")).alias(x) for x in LAYERS])
    shown = _with_end(_with_end(versions.select("source", "target", "anom", "from", "to"), states, "source"), states, "target")
    of_edges = _steps(shown.where("NOT collapsed"), [], ("edges", F.lit(1)), ("anomalous", F.col("anom")))
    pairs = shown.where(F.col("collapsed") & (F.col("source") != F.col("target")) & (F.col("target") != K.SUPER_EXTERNAL_NOISE))
    in_pair = Window.partitionBy("source", "target").orderBy("b")
    there = (_steps(pairs, ["source", "target"], ("n", F.lit(1)))
             .withColumn("there", F.sum("n").over(_running("b", "source", "target")) > 0))
    of_pairs = there.select("b", turned(F.col("there"), F.lag("there").over(in_pair)).alias("edges"))
    names = ("signal", "high", *LAYERS, "edges", "anomalous")
    per = None
    for part in (of_nodes, of_edges, of_pairs, batches.select("b")):
        part = part.select(F.col("b").cast("long").alias("b"), *[F.col(c) if c in part.columns else F.lit(0).cast("long").alias(c) for c in names])
        part = part.groupBy("b").agg(*[F.sum(c).alias(c) for c in names])
        per = part if per is None else per.unionByName(part)
    per = per.groupBy("b").agg(*[F.sum(c).alias(c) for c in names])
    # one row per batch
    up_to = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = per.select("b", *[F.sum(c).over(up_to).cast("long").alias(c) for c in names])
    supers = sum((F.col(x) > 0).cast("long") for x in LAYERS)
    return total.select(
        F.col("b").alias("batch_id"), F.col("anomalous").alias("anomalous_edges_count"), F.col("high").alias("high_risk_nodes_count"),
        F.col("anomalous").alias("detected_lateral_chains"), (F.col("signal") + supers).alias("total_nodes"), F.col("edges").alias("total_edges"))

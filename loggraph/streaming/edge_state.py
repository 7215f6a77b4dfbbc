"""T4: the edge aggregate as keyed streaming state.

A stream over the stored edge facts (one row per edge, user, status and micro-batch, so
a hot edge arrives pre-aggregated) updates one state per edge in the state store: its
totals as a value, its users and statuses as a map of which only the touched entries are
read. A trigger costs what its facts cost, however much came before. The changed edges
leave the trigger with their new totals; all edges are read from the state store itself.

A fact carries its batch; the map remembers the last batch of each (user, status), so a
replayed batch adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loggraph import constants as K
from loggraph.operators.edges import EDGE_KEYS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOTALS = ("total_attempts long, successful_auths long, failed_auths long, n_users long, has_priv_user boolean, "
          "status_code int, status_n long, count_4xx long, count_5xx long, first_timestamp string, last_timestamp string")
FIELDS = [f.split(" ")[0] for f in TOTALS.split(", ")]
CHANGES = "protocol string, src_ip string, k2 string, k3 string, " + TOTALS
FACT_KEY, FACT_VALUE = "user string, status int", "n long, batch long"
#: Stands for a null status in a map key.
NO_STATUS = -1


def _earlier(a: str | None, b: str | None) -> str | None:
    return min((x for x in (a, b) if x is not None), default=None)


def _later(a: str | None, b: str | None) -> str | None:
    return max((x for x in (a, b) if x is not None), default=None)


class EdgeState(StatefulProcessor):
    """Totals of one edge; counts only grow, so the modal status follows from each
    status's new count alone (ties: the smaller status)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        self.facts = handle.getMapState("facts", FACT_KEY, FACT_VALUE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        t = dict(zip(FIELDS, self.totals.get() if self.totals.exists() else (0, 0, 0, 0, False, None, 0, 0, 0, None, None)))
        changed = False
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            for r in frame.sort_values("b").itertuples(index=False):
                status = NO_STATUS if r.status_code is None else int(r.status_code)
                # an absent user is no empty one
                k = ("" if r.user is None else f"={r.user}", status)
                n, last = self.facts.getValue(k) if self.facts.containsKey(k) else (0, -1)
                if int(r.b) <= last:
                    continue
                changed = True
                if not n and r.user is not None:
                    t["n_users"] += 1
                    t["has_priv_user"] = t["has_priv_user"] or r.user in K.PRIVILEGED_USERS
                n += int(r.n)
                self.facts.updateValue(k, (n, int(r.b)))
                t["total_attempts"] += int(r.n)
                t["successful_auths"] += int(r.n_success)
                t["failed_auths"] += int(r.n_failure)
                if status != NO_STATUS:
                    if n > t["status_n"] or (n == t["status_n"] and status < t["status_code"]):
                        t["status_code"], t["status_n"] = status, n
                    t["count_4xx"] += int(r.n) * (400 <= status < 500)
                    t["count_5xx"] += int(r.n) * (status >= 500)
                t["first_timestamp"] = _earlier(t["first_timestamp"], r.first_timestamp)
                t["last_timestamp"] = _later(t["last_timestamp"], r.last_timestamp)
        if changed:
            row = tuple(t[f] for f in FIELDS)
            self.totals.update(row)
            yield pd.DataFrame([(*key, *row)], columns=[*EDGE_KEYS, *FIELDS], dtype=object)

    def close(self) -> None:
        pass


def edge_changes(facts: DataFrame) -> DataFrame:
    """Streaming edge facts (with their batch ``b``) -> the edges each trigger changed,
    with their new totals."""
    return facts.groupBy(*EDGE_KEYS).transformWithStateInPandas(EdgeState(), CHANGES, "Update", "None")


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def edge_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """All edges as the state store holds them (columns as ``edges.counts_from_facts``)."""
    return _state(spark, checkpoint, "totals").select("key.*", "value.*").drop("status_n")


def edge_users(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Long table (id, user) of the SSH edges from the state store."""
    held = _state(spark, checkpoint, "facts").where((F.col("key.protocol") == "SSH") & (F.col("user_map_key.user") != ""))
    return held.select(F.concat(F.lit("edge:"), "key.src_ip", F.lit("->"), "key.k2").alias("id"),
                       F.substring(F.col("user_map_key.user"), 2, 1 << 30).alias("user")).distinct()

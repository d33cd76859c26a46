"""Supervised workflows as a stream whose commands may arrive late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from memograph.operators.workflow import owner_of, requested_state

LOG = "workspace_id string, workflow_id string, seq long, us long, kind string, from_value string, to_value string"
COMMAND = StructType([StructField("us", LongType()), StructField("seq", LongType()), *[
    StructField(c, StringType()) for c in ("to_state", "to_person", "asset")]])
HELD = StructType([StructField("state", StringType()), StructField("person", StringType()), StructField("until", LongType())])
ASSET = StructType([StructField("asset", StringType())])


class _Workflow(StatefulProcessor):
    """Commands wait in state until the watermark has passed them.

    Then no earlier one can come any more: they are applied, in the order of their time, to the
    state, the assignee and the set of linked assets, and every change is a row of the log.
    State is reached over a socket: a batch is added to the waiting ones in one call, and a single
    timer stands for the earliest of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", COMMAND)
        self.held = handle.getValueState("held", HELD)
        self.assets = handle.getMapState("assets", ASSET, ASSET)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            sent = [(int(us), int(seq), *(None if pd.isna(c) else c for c in command))
                    for us, seq, *command in frame[["us", "seq", "to_state", "to_person", "asset"]].itertuples(index=False)]
            if sent:
                self.waiting.appendList(sent)
                first = min(c[0] for c in sent) if first is None else min(first, *(c[0] for c in sent))
        if first is not None:
            self._wake(first)
        return iter([])

    def _wake(self, us: int) -> None:
        # The watermark counts whole milliseconds: a timer fires once it has passed this one.
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, person, until = self.held.get() if self.held.exists() else (None, None, -1)
        passed = timerValues.getCurrentWatermarkInMs()
        if expiredTimerInfo.getExpiryTimeInMs() <= until:
            return  # released together with an earlier timer of this batch
        # A command sent again takes the place of the one before.
        waiting = {(c[0], c[1]): tuple(c) for c in self.waiting.get()}
        due = sorted(place for place in waiting if place[0] // 1000 + 1 <= passed)
        linked = {a[0] for a in self.assets.keys()} if any(waiting[place][4] is not None for place in due) else set()
        out = []
        for us, seq in due:
            to_state, to_person, asset = waiting.pop((us, seq))[2:]
            if to_state is not None and to_state != state:
                out.append((key[0], key[1], seq, us, "state", state, to_state))
                state = to_state
            if to_person is not None and to_person != person:
                out.append((key[0], key[1], seq, us, "assignee", person, to_person))
                person = to_person
            if asset is not None and asset not in linked:
                linked.add(asset)
                self.assets.updateValue((asset,), (asset,))
                out.append((key[0], key[1], seq, us, "link", None, asset))
        if waiting:
            self.waiting.put(list(waiting.values()))
            self._wake(min(us for us, _ in waiting))
        else:
            self.waiting.clear()
        self.held.update((state, person, passed))
        if out:
            yield pd.DataFrame(out, columns=["workspace_id", "workflow_id", "seq", "us", "kind", "from_value", "to_value"])

    def close(self) -> None:
        pass


def log(commands: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Changes of state and assignee and first links, in the order of (ts, seq), as the watermark passes them.

    commands: workspace_id, workflow_id, workflow_type, seq, ts, action, state, assignee,
    related_event. A command may come up to `delay` behind the newest one, in any batch; later
    ones are dropped by the watermark. An escalated workflow goes to the owner of its type. A
    command sent again counts once. What lies within `delay` of the newest command waits.
    Needs the RocksDB state store.
    """
    person = F.when(F.col("action") == "escalate", owner_of(F.col("workflow_type"))).otherwise(F.col("assignee"))
    asked = commands.withWatermark("ts", delay).select(
        "workspace_id", "workflow_id", "seq", "ts", F.unix_micros("ts").alias("us"), requested_state().alias("to_state"),
        person.alias("to_person"), F.col("related_event").alias("asset"))
    return asked.groupBy("workspace_id", "workflow_id").transformWithStateInPandas(
        statefulProcessor=_Workflow(), outputStructType=LOG, outputMode="Append", timeMode="EventTime")

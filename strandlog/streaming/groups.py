"""Consumer groups as a state machine over membership events.

``advance`` is the machine; ``replay`` runs it over a bounded log of events in
sorted tasks, ``GroupProcessor`` over a stream, so both give the same rows.
Events: seq, group_id, member_id, kind (join, heartbeat, leave, tick), topics
(comma-separated, in order), strategy, timeout_ms, event_ms.

Before an event, members that were silent for longer than their timeout go, and
the group has a new generation. A join without an id that the group knows gets
one from the coordinator (the group's id and a running number): names that
members choose have no meaning. A join that is new, or lists other topics or
another order of them, and a leave each make a new generation; a join without a
group or topics is refused. The strategy is that of the group's first join. Each
generation deals the partitions of all members' topics anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "group_id string, seq long, generation long, members long, leader string, strategy string, changed boolean, member_id string, error string, assignment string"


def fresh() -> dict:
    return {"generation": 0, "strategy": None, "members": {}, "given": 0}


def assign(strategy: str, members: list[str], topics: dict[str, int]) -> dict[str, list[str]]:
    """Partitions (``topic-number``) of each member, members in order of their ids, topics in order of their names."""
    ids, out = sorted(members), {m: [] for m in members}
    place = 0
    for t in sorted(topics):
        n, k = topics[t], len(ids)
        for p in range(n):
            if strategy == "roundrobin":
                owner = place % k
            else:
                more, each = n % k, n // k
                owner = p // (each + 1) if p < more * (each + 1) else more + (p - more * (each + 1)) // each
            out[ids[owner]].append(f"{t}-{p}")
            place += 1
    return out


def advance(state: dict, event) -> tuple[dict, dict]:
    """The state after an event, and what the event got: generations, the member's id, an error."""
    members, before = state["members"], state["generation"]
    got = {"member_id": event.member_id or None, "error": None}
    late = [m for m, v in members.items() if event.event_ms - v["seen"] > v["timeout"] and m != event.member_id]
    for m in late:
        del members[m]
    state["generation"] += bool(late)
    if event.kind == "join":
        if not event.group_id or not event.topics:
            got["error"] = "INVALID_ARGUMENT"
        else:
            state["strategy"] = state["strategy"] or event.strategy
            if event.member_id not in members:
                state["given"] += 1
                got["member_id"] = f"{event.group_id}-{state['given']}"
            old = members.get(got["member_id"])
            state["generation"] += old is None or old["topics"] != event.topics
            members[got["member_id"]] = {"topics": event.topics, "timeout": int(event.timeout_ms), "seen": int(event.event_ms)}
    elif event.kind == "leave":
        if members.pop(event.member_id, None) is None:
            got["error"] = "UNKNOWN_MEMBER"
        else:
            state["generation"] += 1
    elif event.kind == "heartbeat":
        if event.member_id in members:
            members[event.member_id]["seen"] = int(event.event_ms)
        else:
            got["error"] = "UNKNOWN_MEMBER"
    got["changed"] = state["generation"] != before
    return state, got


def row(group_id: str, event, state: dict, got: dict, partitions: dict[str, int]) -> tuple:
    members = state["members"]
    dealt = None
    if got["changed"] and members:
        topics = {t: partitions[t] for m in members.values() for t in m["topics"].split(",") if t in partitions}
        dealt = json.dumps(assign(state["strategy"], list(members), topics), sort_keys=True)
    return group_id, int(event.seq), state["generation"], len(members), min(members, default=None), state["strategy"], got["changed"], got["member_id"], got["error"], dealt


def replay(events: DataFrame, partitions: dict[str, int] | None = None) -> DataFrame:
    """The groups' history from a bounded event log: rows stream through, one group's state at a time.

    ``partitions``: of each topic; topics without are dealt to nobody.
    """
    partitions = partitions or {}

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        group, state = None, None
        for pdf in batches:
            out = []
            for e in pdf.itertuples(index=False):
                if e.group_id != group:
                    group, state = e.group_id, fresh()
                state, got = advance(state, e)
                out.append(row(group, e, state, got, partitions))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return events.repartition("group_id").sortWithinPartitions("group_id", "seq").mapInPandas(run, OUT)


class GroupProcessor(StatefulProcessor):
    """The same machine for a stream, keyed by group; the state is one JSON value."""

    def __init__(self, partitions: dict[str, int] | None = None):
        self.partitions = partitions or {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("group", "doc string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        state = json.loads(self.state.get()[0]) if self.state.exists() else fresh()
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            state, got = advance(state, e)
            out.append(row(key[0], e, state, got, self.partitions))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream(events: DataFrame, partitions: dict[str, int] | None = None) -> DataFrame:
    """The groups' history of a stream of events."""
    return events.groupBy("group_id").transformWithStateInPandas(GroupProcessor(partitions), OUT, "Append", "None")


def windows(records: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time counts per window (an extension: the log itself has no event-time windows)."""
    at = F.timestamp_millis("timestamp_ms")
    return records.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", size), "partition").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))

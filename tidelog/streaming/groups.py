"""A reader group's coordinator as a stateful stream: commands and new segments in, answers out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

ANSWER = "group_id string, topic_id long, at_us long, seq long, kind string, reader_id string, status string, start_offset long, end_offset long, committed_watermark long"


class Machine:
    """One group on one topic: the steps of operators.groupstate, one command after the other."""

    def __init__(self, state: dict | None, lease_us: int, session_us: int, max_inflight: int, most: int = 10):
        self.s = state or {"cursor": 0, "members": {}, "leases": [], "segments": []}
        self.lease_us, self.session_us, self.max_inflight, self.most = lease_us, session_us, max_inflight, most

    def watermark(self) -> int:
        return min((x[0] for x in self.s["leases"]), default=self.s["cursor"])

    def out(self, gone: set) -> None:
        lost = [x for x in self.s["leases"] if x[2] in gone]
        self.s["leases"] = [x for x in self.s["leases"] if x[2] not in gone]
        self.s["cursor"] = min([self.s["cursor"], *(x[0] for x in lost)])
        self.s["members"] = {k: v for k, v in self.s["members"].items() if k not in gone}

    def step(self, kind: str, reader: str, at: int, start: int, end: int, size: int) -> tuple:
        """status, start, end."""
        s = self.s
        if kind == "segment":
            s["segments"].append([start, end, size])
            return None
        if kind == "join":
            s["members"][reader] = at
            return "OK", None, None
        if kind == "poll":
            return self.poll(reader, at, size)
        if kind == "heartbeat":
            if reader not in s["members"]:
                return "UNKNOWN_MEMBER", None, None
            s["members"][reader] = at
            s["leases"] = [[a, b, r, at + self.lease_us if r == reader else x] for a, b, r, x in s["leases"]]
            self.out({r for r, t in s["members"].items() if t < at - self.session_us})
            return "OK", None, None
        if kind == "commit":
            mine = [x for x in s["leases"] if x[:3] == [start, end, reader]]
            s["leases"] = [x for x in s["leases"] if x not in mine]
            done = self.watermark()
            s["segments"] = [x for x in s["segments"] if x[1] > done]
            return "OK" if mine else "NOT_OWNER", start, end
        if kind == "leave":
            self.out({reader})
            return "OK", None, None
        raise ValueError(f"unknown command {kind}")

    def poll(self, reader: str, at: int, max_bytes: int) -> tuple:
        s = self.s
        if reader not in s["members"]:
            return "OK", None, None
        if sum(x[2] == reader for x in s["leases"]) >= self.max_inflight:
            return "MAX_INFLIGHT", None, None
        old = min((x for x in s["leases"] if x[3] < at), default=None)
        if old:
            s["leases"] = [x for x in s["leases"] if x is not old] + [[old[0], old[1], reader, at + self.lease_us]]
            return "OK", old[0], old[1]
        spot = min(p for p in [s["cursor"], *(x[1] for x in s["leases"] if x[1] > s["cursor"])] if not any(a <= p < b for a, b, _, _ in s["leases"]))
        until = min((x[0] for x in s["leases"] if x[0] > spot), default=None)
        ahead = [x for x in sorted(s["segments"]) if x[1] > spot and (until is None or x[0] < until)][: self.most]
        to, taken = None, 0
        for _, end, size in ahead:
            to, taken = end, taken + size
            if taken >= max_bytes:
                break
        if to is None:
            return "OK", None, None
        to = to if until is None else min(to, until)
        s["leases"].append([spot, to, reader, at + self.lease_us])
        s["cursor"] = to
        return "OK", spot, to


class Coordinator(StatefulProcessor):
    """Commands of a group and topic in the order of (at_us, seq); the state is one small document: its leases, members, and the segments
    that are not committed yet."""

    def __init__(self, lease_us: int, session_us: int, max_inflight: int):
        self.limits = lease_us, session_us, max_inflight

    def init(self, handle) -> None:
        self.doc = handle.getValueState("doc", "json string")

    def handleInputRows(self, key, rows, timer_values):
        machine = Machine(json.loads(self.doc.get()[0]) if self.doc.exists() else None, *self.limits)
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["at_us", "seq"], ignore_index=True)
        number = lambda x: None if x is None or x != x else int(x)
        out = []
        for r in pdf.itertuples():
            got = machine.step(r.kind, r.reader_id, int(r.at_us), number(r.start_offset), number(r.end_offset), number(r.bytes))
            if got:
                out.append((*key, int(r.at_us), int(r.seq), r.kind, r.reader_id, *got, machine.watermark()))
        self.doc.update((json.dumps(machine.s),))
        names = [c.split()[0] for c in ANSWER.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"start_offset": "Int64", "end_offset": "Int64"})

    def close(self) -> None:
        pass


def coordinate(commands: DataFrame, lease_us: int, session_us: int, max_inflight: int) -> DataFrame:
    """commands (batch or stream): group_id, topic_id, at_us, seq, kind (segment, join, poll, heartbeat, commit, leave), reader_id, start_offset,
    end_offset, bytes (of a segment, or a poll's budget). One answer for each command but segments; needs the RocksDB state store."""
    return commands.groupBy("group_id", "topic_id").transformWithStateInPandas(Coordinator(lease_us, session_us, max_inflight), ANSWER, "Append", "None")

"""A spool with acknowledged deliveries, as a stream's state.

Suppressed frames wait in their device's spool, which holds a number of bytes at most and drops the oldest for a new one. When
the device wakes, its oldest frames are sent, a few at once; a frame leaves the spool when its answer says that it was
accepted, and at the first failure, or when the time of a delivery is over, what has no answer stays for the next one. So
nothing that wasn't accepted or dropped is lost, and a frame is sent again only after a delivery that ended without its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


@dataclass(frozen=True)
class SpoolConfig:
    """The published bounds of the store and of one delivery."""

    bytes: int = 512 * 1024
    records: int = 8
    seconds: float = 20.0


#: What rows are: a frame to keep, a chance to deliver, and answers to the oldest frame that was sent and has none.
RECORD, WAKE, ACCEPTED, FAILED = "record", "wake", "accepted", "failed"
OUT = "device long, us long, id long, delivery long, outcome string"


@dataclass
class Spool:
    """One device's spool: records (us, id, bytes) oldest first, of which the first `waiting` were sent and have no answer,
    bytes in use, the delivery's number and end (None: none is open), and how many records were dropped."""

    config: SpoolConfig
    records: list[tuple[int, int, int]] = field(default_factory=list)
    waiting: int = 0
    delivery: int = 0
    until: int | None = None
    dropped: int = 0

    def step(self, kind: str, us: int, id: int | None, size: int) -> list[tuple[int, int | None, int, str]]:
        """Takes a row and gives (us, id, delivery, outcome) of what follows from it."""
        out = self.expire(us)
        if kind == RECORD:
            used = sum(r[2] for r in self.records)
            while used + size > self.config.bytes and len(self.records) > self.waiting:
                gone = self.records.pop(self.waiting)  # the oldest that isn't on its way
                used -= gone[2]
                self.dropped += 1
                out.append((us, gone[1], self.delivery, "dropped"))
            self.records.append((us, id, size))
        elif kind == WAKE and self.until is None and self.records:
            self.delivery += 1
            self.waiting = min(len(self.records), self.config.records)
            self.until = us + int(self.config.seconds * 1e6)
            out += [(us, r[1], self.delivery, "sent") for r in self.records[: self.waiting]]
        elif kind == ACCEPTED and self.waiting:
            done = self.records.pop(0)
            self.waiting -= 1
            out.append((us, done[1], self.delivery, "accepted"))
            if not self.waiting:
                self.until = None
        elif kind == FAILED and self.waiting:
            out.append((us, self.records[0][1], self.delivery, "failed"))
            self.waiting, self.until = 0, None
        return out

    def expire(self, us: int) -> list[tuple[int, int | None, int, str]]:
        """Ends a delivery whose time was over before `us`."""
        if self.until is None or us <= self.until:
            return []
        out = [(self.until, self.records[0][1], self.delivery, "expired")]
        self.waiting, self.until = 0, None
        return out


class _Spools(StatefulProcessor):
    def __init__(self, config: SpoolConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", "us long, id long, bytes long")
        self.rest = handle.getValueState("rest", "waiting int, delivery long, until long, dropped long")

    def _loaded(self) -> Spool:
        spool = Spool(self.config, [tuple(r) for r in self.records.get()] if self.records.exists() else [])
        if self.rest.exists():
            spool.waiting, spool.delivery, spool.until, spool.dropped = self.rest.get()
        return spool

    def _keep(self, spool: Spool, before: int | None) -> None:
        if spool.records:
            self.records.put([tuple(map(int, r)) for r in spool.records])
        else:
            self.records.clear()
        self.rest.update((int(spool.waiting), int(spool.delivery), None if spool.until is None else int(spool.until), int(spool.dropped)))
        if before != spool.until:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + 1)
            if spool.until is not None:
                self.handle.registerTimer(int(spool.until) // 1000 + 1)

    def handleInputRows(self, key: tuple, batches: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        spool = self._loaded()
        before, out = spool.until, []
        rows = pd.concat(list(batches)).sort_values(["us", "id"])
        for kind, us, i, size in zip(rows["kind"], rows["us"], rows["id"], rows["bytes"], strict=True):
            out += spool.step(kind, int(us), int(i), int(size))
        self._keep(spool, before)
        yield from _frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        spool = self._loaded()
        out = spool.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if out:
            self._keep(spool, None)  # the timer is gone by itself
        yield from _frame(key, out)

    def close(self) -> None:
        pass


def _frame(key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
    if out:
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[c.split()[0] for c in OUT.split(", ")])


def acknowledged(stream: DataFrame, late: str = "0 seconds", config: SpoolConfig = SpoolConfig()) -> DataFrame:
    """(device, us, id, delivery, outcome) of a stream of (device, us, id, bytes, kind, captured_at): what was sent, accepted,
    failed, expired and dropped, and when.

    Rows of a device within a batch are put in the order of us and id, a batch behind another is later. The state of a device
    is bounded by the bytes of its spool and survives restarts; a delivery that no later row ends is ended by a timer on the
    watermark, so with outcomes that don't hang on how rows fell into batches."""
    rows = stream.withWatermark("captured_at", late).select("device", "us", "id", "bytes", "kind", "captured_at")
    return rows.groupBy("device").transformWithStateInPandas(_Spools(config), OUT, "append", "eventTime")

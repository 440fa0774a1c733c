"""The life of jobs on a stream: illegal steps, ends and jobs that are stuck, in event time.

Events (event_id, job, state, at) wait, by job, until the watermark has passed their time, and are then taken in order of
(at, event_id); so events that come out of order or twice, within the watermark's delay, give what a batch over all of them
gives.  State is the waiting events and one row a job; both go when a job has ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from voxelith.operators.lifecycle import FAILED, transitions

OUT = "job string, kind string, source string, target string, at timestamp, started_at timestamp"
#: Kinds of rows.
ILLEGAL, ENDED, STUCK = "ILLEGAL", "END_TO_END", "STUCK"


def judged(jobs: DataFrame, steps: list[str]) -> DataFrame:
    """Of a whole history: every illegal step and every job's first end, as a stream gives them."""
    allowed = {f"{a}>{b}" for a, b in transitions(steps)}
    ends = [steps[-1], FAILED]
    w = Window.partitionBy("job").orderBy("at", "event_id")
    rows = jobs.dropDuplicates(["event_id"]).withColumns({"source": F.lag("state").over(w), "started_at": F.first("at").over(w), "_done": F.coalesce(F.max(F.col("state").isin(ends)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    rows = rows.where("not _done").withColumnRenamed("state", "target")
    step = F.concat("source", F.lit(">"), "target")
    illegal = rows.where(F.col("source").isNotNull() & (F.col("source") != F.col("target")) & ~step.isin(sorted(allowed))).select("job", F.lit(ILLEGAL).alias("kind"), "source", "target", "at", F.lit(None).cast("timestamp").alias("started_at"))
    ended = rows.where(F.col("target").isin(ends)).select("job", F.lit(ENDED).alias("kind"), "source", "target", "at", "started_at")
    return illegal.unionByName(ended)


class Life(StatefulProcessor):
    """One job's waiting events, its last state and when it began."""

    def __init__(self, steps: list[str], stuck_ms: int):
        self.allowed, self.ends, self.stuck_ms = set(transitions(steps)), {steps[-1], FAILED}, stuck_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id string", "state string, at bigint")
        self.now = handle.getValueState("now", "state string, started bigint, at bigint, ended boolean, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = self.now.exists() and self.now.get()[3]
        for pdf in rows:
            for event, state, at in zip(pdf["event_id"], pdf["state"], pdf["at"], strict=True):
                if not ended:
                    ms = int(at.value // 1_000_000)
                    self.waiting.updateValue((str(event),), (state, int(at.value // 1000)))
                    self.handle.registerTimer(ms + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        (job,) = key
        due = sorted((v[1], k[0], v[0]) for k, v in self.waiting.iterator() if v[1] < mark)
        state, began, last, ended, told = self.now.get() if self.now.exists() else (None, None, None, False, False)
        out = []
        for at, event, target in due:
            self.waiting.removeKey((event,))
            if ended:
                continue
            began = at if began is None else began
            if state is not None and target != state and (state, target) not in self.allowed:
                out.append((job, ILLEGAL, state, target, at, None))
            if target in self.ends:
                out.append((job, ENDED, state, target, at, began))
                ended = True
            state, last = target, at
        if due:
            self.now.update((state, began, last, ended, False))
            if not ended:
                self.handle.registerTimer(last // 1000 + self.stuck_ms)
        elif not ended and not told and last is not None and last // 1000 + self.stuck_ms <= mark // 1000 and not any(True for _ in self.waiting.keys()):
            out.append((job, STUCK, state, None, last, began))
            self.now.update((state, began, last, False, True))
        pdf = pd.DataFrame(out, columns=["job", "kind", "source", "target", "at", "started_at"])
        yield pdf.assign(**{c: pd.to_datetime(pdf[c], unit="us") for c in ("at", "started_at")})

    def close(self) -> None:
        pass


def watched(events: DataFrame, steps: list[str], late: str = "10 minutes", stuck_ms: int = 3_600_000) -> DataFrame:
    """A stream of events (event_id, job, state, at) to rows of OUT: illegal steps, ends, and jobs without an event for stuck_ms."""
    keyed = events.withWatermark("at", late).groupBy("job")
    return keyed.transformWithStateInPandas(Life(steps, stuck_ms), OUT, "append", "eventTime")

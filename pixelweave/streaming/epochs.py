"""Training logs as a stream: learning rate and early stop of each run, in order of evaluation.

Evaluations of a run may come late or out of order. They wait in the run's state until a timer tells that the
watermark has passed them, then count in order of time, one by one: the rate falls by `factor` after more than `patience`
evaluations without a relative gain on the best loss, the run stops after `stop_after` evaluations without any gain. An
evaluation without a loss ends its run and releases what waits. What comes after a run's stop, or for an epoch that has
been counted, is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run string, epoch int, loss double, best double, waited int, bad int, rate double, stop boolean"
STATE = "epoch int, best double, plateau double, waited int, bad int, rate double, stop boolean"
#: A loss has to fall by this share of the best to count for the rate, and a rate by this much to change.
GAIN, LEAST = 1e-4, 1e-8


class Progress(StatefulProcessor):
    """Per run: where it stands, and the evaluations that wait."""

    def __init__(self, rate: float, factor: float, patience: int, stop_after: int):
        self.rate, self.factor, self.patience, self.stop_after = rate, factor, patience, stop_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", STATE)
        self.waiting = handle.getListState("waiting", "epoch int, at long, loss double")

    def step(self, now: tuple, epoch: int, loss: float) -> tuple:
        """Where a run stands after one more evaluation."""
        _, best, plateau, waited, bad, rate, _ = now
        waited = 0 if best is None or loss < best else waited + 1
        best = loss if best is None or loss < best else best
        if plateau is None or loss < plateau * (1 - GAIN):
            plateau, bad = loss, 0
        else:
            bad += 1
        if bad > self.patience:
            lower = rate * self.factor
            rate, bad = (lower if rate - lower > LEAST else rate), 0
        return epoch, best, plateau, waited, bad, rate, waited >= self.stop_after

    def release(self, run: str, until: int | None) -> Iterator[pd.DataFrame]:
        """Count the waiting evaluations up to a time, all for None."""
        held = sorted(self.waiting.get())
        ready = [w for w in held if until is None or w[1] <= until]
        now = tuple(self.now.get()) if self.now.exists() else (-1, None, None, 0, 0, self.rate, False)
        out = []
        for epoch, _, loss in ready:
            if epoch > now[0] and not now[6]:
                now = self.step(now, epoch, loss)
                out.append((run, epoch, loss, now[1], now[3], now[4], now[5], now[6]))
        self.now.update(now)
        self.waiting.clear()
        if rest := held[len(ready) :]:
            self.waiting.put(rest)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTPUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ended = False
        for df in rows:
            for epoch, ts, loss in zip(df["epoch"], df["ts"], df["loss"], strict=True):
                if pd.isna(loss):
                    ended = True
                    continue
                at = int(pd.Timestamp(ts).timestamp() * 1000)
                self.waiting.appendValue((int(epoch), at, float(loss)))
                if at > timerValues.getCurrentWatermarkInMs():
                    self.handle.registerTimer(at)
        yield from self.release(key[0], None if ended else timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.release(key[0], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def progress(evaluations: DataFrame, rate: float = 1e-3, factor: float = 0.1, patience: int = 5, stop_after: int = 10, late: str = "1 day") -> DataFrame:
    """Columns of OUTPUT for a stream of evaluations(run, epoch, ts timestamp, loss), up to `late` out of order.

    The session's state store has to be RocksDB.
    """
    rows = evaluations.withWatermark("ts", late).select("run", "epoch", "ts", "loss")
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=Progress(rate, factor, patience, stop_after), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")

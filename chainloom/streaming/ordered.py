"""Release of blocks in order: what comes early waits until the gap before it closes.

Only numbers go through the stateful operator, as runs that tasks make of their rows first; payloads stay in the staged
files and are read by range once a range is released. So the state of a chain is its next number and the runs that wait,
and one task a chain sees a few rows a batch however many blocks come. Repeats are dropped. A gap that stays open for
`patience` seconds is reported (kind "gap": the numbers that are missing) and goes on being waited for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

RELEASED = "chain_id bigint, kind string, start_block bigint, end_block bigint"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive numbers (first, last) of numbers in any order."""
    n = np.unique(numbers)
    cuts = np.flatnonzero(np.diff(n) > 1)
    return list(zip(n[np.concatenate([[0], cuts + 1])].tolist(), n[np.concatenate([cuts, [len(n) - 1]])].tolist())) if len(n) else []


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches in order, those that meet or overlap put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_runs(blocks: DataFrame) -> DataFrame:
    """chain_id, start_block and end_block of the runs of each batch of rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chains, numbers = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            found = [(int(c), *r) for c in np.unique(chains) for r in runs(numbers[chains == c])]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["chain_id", "start_block", "end_block"])

    whole = blocks.where("chain_id is not null and block_number is not null")
    return whole.select(F.col("chain_id").cast("long"), F.col("block_number").cast("long")).mapInArrow(rows, "chain_id bigint, start_block bigint, end_block bigint")


class Release(StatefulProcessor):
    """State of a chain: the next number to release, and runs beyond it."""

    def __init__(self, start: int, patience: float):
        self.start, self.patience = start, patience

    def init(self, handle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "number bigint")
        self.waiting = handle.getMapState("waiting", "start_block bigint", "end_block bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else self.start
        came = [(int(a), int(b)) for part in rows for a, b in zip(part["start_block"], part["end_block"])]
        held = {int(k[0]): int(v[0]) for k, v in self.waiting.iterator()}
        left, first = [], at
        for a, b in merged([*came, *held.items()]):
            if a <= at:
                at = max(at, b + 1)
            else:
                left.append((a, b))
        for a in held:
            if (a, held[a]) not in left:
                self.waiting.removeKey((a,))
        for a, b in left:
            if held.get(a) != b:
                self.waiting.updateValue((a,), (b,))
        self.next.update((at,))
        if at != first or not left:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if left and (at != first or not held):
            self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.patience))
        if at > first:
            yield pd.DataFrame({"chain_id": [key[0]], "kind": ["release"], "start_block": [first], "end_block": [at - 1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, held = self.next.get()[0], sorted(int(k[0]) for k, _ in self.waiting.iterator())
        if held:
            self.handle.registerTimer(int(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.patience))
            yield pd.DataFrame({"chain_id": [key[0]], "kind": ["gap"], "start_block": [at], "end_block": [held[0] - 1]})

    def close(self) -> None:
        pass


def released(blocks: DataFrame, start: int = 0, patience: float = 60.0) -> DataFrame:
    """Ranges of blocks (chain_id, block_number of a stream) that can be published, in order, and gaps that stay open.

    The session's state store has to be the one of STORE.
    """
    return in_runs(blocks).groupBy("chain_id").transformWithStateInPandas(Release(start, patience), RELEASED, "append", "processingTime")


def publish_in_order(stream: DataFrame, payload: Callable[[int, int, int], DataFrame], publish: Callable[[DataFrame, int, int, int], None], checkpoint: str, start: int = 0, patience: float = 60.0, report: Callable[[int, int, int], None] | None = None, **trigger) -> StreamingQuery:
    """publish(rows, chain, first, last) for every released range, each once a batch and in order.

    payload(chain, first, last) gives the rows of a range, distributed. A batch that is run again after a failure releases
    the same ranges, so publish should write a range to a place of its own and replace it. report gets open gaps, which show
    with the next batch where the stream ends with its data (availableNow), else without one.
    """

    def batch(df: DataFrame, number: int) -> None:
        for r in sorted(df.collect()):  # one row a chain, or a gap
            if r.kind == "release":
                publish(payload(r.chain_id, r.start_block, r.end_block), r.chain_id, r.start_block, r.end_block)
            elif report:
                report(r.chain_id, r.start_block, r.end_block)

    trigger = trigger or {"availableNow": True}
    wanted = {"spark.sql.streaming.stateStore.providerClass": STORE, "spark.sql.streaming.noDataMicroBatches.enabled": str("availableNow" not in trigger).lower()}
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in wanted}  # a query keeps what holds at its start
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        return released(stream, start, patience).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)

"""A sample of n points that a stream of draws renews: each accepted draw overwrites a uniform slot.

The slots are the state of the stream. They are kept in blocks, so that a batch wakes a block once for
all its slots; slots are hashes of the draw's number, and blocks therefore get equal shares of any stream.
The latest draw of a slot wins, in whatever order draws arrive, so the sample after a number of draws is the
one that ``sampling.refreshed_sample`` makes of the same draws at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geometry import hash16

SLOT = "idx int, d long, z int, y int, x int"
POINT = ["d", "z", "y", "x"]
#: Slots of a block.
BLOCK = 64
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Let streams that the session starts from now on hold slots; one that goes on from a checkpoint keeps the store named there."""
    spark.conf.set(STATE_STORE, ROCKS)


class Slots(StatefulProcessor):
    """The points of one block's slots. A batch returns the slots that it changed, with their new points."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "idx int", "d long, z int, y int, x int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for idx, *point in initialState[["idx", *POINT]].itertuples(index=False):
            self.slots.updateValue((int(idx),), tuple(map(int, point)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None  # one row a slot, however many draws there are
        for some in rows:
            some = some if latest is None else pd.concat([latest, some])
            latest = some.sort_values("d").drop_duplicates("idx", keep="last")
        changed = []
        for idx, *point in latest[["idx", *POINT]].itertuples(index=False):
            held = self.slots.getValue((int(idx),))
            if held is None or held[0] < point[0]:
                self.slots.updateValue((int(idx),), tuple(map(int, point)))
                changed.append((idx, *point))
        if changed:
            yield pd.DataFrame(changed, columns=["idx", *POINT])

    def close(self) -> None:
        pass


def reservoir_stream(sample: DataFrame, accepted: DataFrame, n: int, seed: int) -> DataFrame:
    """(idx, d, z, y, x): slots of a reservoir of ``n`` as accepted draws (d, z, y, x) of a stream change them, in append mode.

    ``sample`` (idx, z, y, x) is what the slots hold before the first draw; it is read once, when the
    stream is started without a checkpoint, and may be empty. The session must be ``prepare``d before the stream is started.
    The state is a point a slot, so it is bounded by ``n`` and needs no watermark.
    """
    block = F.floor(F.col("idx") / BLOCK).cast("int").alias("block")
    drawn = accepted.withColumn("idx", (hash16(seed, 4, F.col("d")) % n).cast("int"))
    held = sample.select("idx", F.lit(-1).cast("long").alias("d"), "z", "y", "x")
    slots = drawn.select(block, "idx", *POINT).groupBy("block")
    return slots.transformWithStateInPandas(Slots(), SLOT, "Append", "None", initialState=held.select(block, "idx", *POINT).groupBy("block"))


def sample_after(sample: DataFrame, changes: DataFrame) -> DataFrame:
    """(idx, z, y, x): what the slots of ``sample`` hold after ``changes`` that ``reservoir_stream`` has returned."""
    held = sample.select("idx", F.lit(-1).cast("long").alias("d"), "z", "y", "x")
    slots = held.unionByName(changes).groupBy("idx").agg(F.max_by(F.struct("z", "y", "x"), "d").alias("p"))
    return slots.select("idx", "p.*")

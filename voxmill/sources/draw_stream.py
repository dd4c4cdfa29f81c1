"""A stream of running numbers for draws, unbounded or up to a last one.

    register(spark)
    spark.readStream.format("draws").options(perBatch=1_000_000, first=0, end=5_000_000).load()

Draw d is a hash of its number, so a range of numbers is all that an offset has to name: a batch that is
run again after a fault, or by a query that is started anew from its checkpoint, has the draws it had before.
A trigger takes ``perBatch`` numbers, ``availableNow`` therefore one batch more of an endless stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Numbers in one Arrow batch.
BATCH_ROWS = 65_536


class Numbers(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class DrawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "draws"

    def schema(self) -> str:
        return "value long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DrawReader(self.options)


class DrawReader(DataSourceStreamReader):
    def __init__(self, options):
        self.first = int(options.get("first", "0"))
        self.end = int(options["end"]) if "end" in options else None
        self.per_batch = int(options.get("perBatch", "1000000"))
        self.per_task = int(options.get("perTask", "250000"))
        if self.per_batch <= 0 or self.per_task <= 0 or self.first < 0:
            raise ValueError("perBatch and perTask must be positive, and first must not be negative")
        self.planned = self.first  # on a restart the engine plans an empty range at the offset it has come to

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        reach = self.planned + self.per_batch
        return {"next": reach if self.end is None else max(self.planned, min(reach, self.end))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.planned = max(self.planned, end["next"])
        cuts = [*range(start["next"], end["next"], self.per_task), end["next"]]
        return [Numbers(low, high) for low, high in zip(cuts, cuts[1:])]

    def read(self, partition: Numbers) -> Iterator[pa.RecordBatch]:
        for low in range(partition.first, partition.end, BATCH_ROWS):
            numbers = np.arange(low, min(low + BATCH_ROWS, partition.end), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers)], names=["value"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DrawSource)

"""Control points as tab-separated text, and small JSON descriptions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES


def control_lines(controls: DataFrame) -> DataFrame:
    """(idx, line): z, y and x with ten decimals, separated by tabs."""
    return controls.select("idx", F.format_string("%.10f\t%.10f\t%.10f", *AXES).alias("line"))


def write_controls(controls: DataFrame, path: str) -> None:
    """One file of lines in the order of idx; a line has at most a few hundred controls."""
    control_lines(controls).orderBy("idx").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """(idx, z, y, x), numbered by line from 0."""
    lines = spark.read.csv(path, sep="\t", schema="z double, y double, x double").withColumn("line", F.monotonically_increasing_id())
    return lines.select((F.row_number().over(Window.orderBy("line")) - 1).cast("int").alias("idx"), *AXES)


def box_json(boxes: DataFrame) -> DataFrame:
    """(m, json) of bounding boxes."""
    return boxes.select("m", F.to_json(F.struct("xmin", "xmax", "ymin", "ymax")).alias("json"))


def shape_json(width: int, height: int, time: int) -> str:
    """The size of a stack."""
    return json.dumps({"width": width, "height": height, "time": time})


def signal_json(signals: DataFrame) -> DataFrame:
    """(m, json): the values of each trace in the order of t."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("t", "val"))), lambda s: s["val"])
    return signals.groupBy("m").agg(F.to_json(ordered).alias("json"))

"""The stack that queries and their SQL share: sums of a cell that lie at a half."""

import datetime
import random

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from voxmill import fixtures as fx

from .test_catalogue import rows_of

#: Queries that read the stack and were found to differ from their SQL on larger tables.
ON_THE_STACK = [
    "seed_trace",
    "spline_frames",
    "spline_coeffs",
    "chord_length",
    "contour_stencil",
    "component_stack",
    "component_shapes",
    "full_rank_reconstruction",
    "cl_to_rgb",
    "csl_to_rgb",
    "hsv_to_rgb",
    "coloured_stack",
]


def test_sums_near_a_half_do_not_depend_on_how_the_table_is_split(spark, tmp_path):
    rng = random.Random(3)
    rows, expected = [], {}
    for px in range(40):
        values = [rng.randrange(1, 60000) / 100 for _ in range(11)]
        cents = sum(round(v * 100) for v in values)
        values[5] = (round(values[5] * 100) + (150 - cents) % 100) / 100  # now the exact sum ends in .50
        total = 0.0
        for v in values:
            total += v
        expected[px] = int(total + 0.5)
        rows += [(len(rows) + i, datetime.datetime(2024, 1, 3, i), px, v) for i, v in enumerate(values)]
    exact = {px: int(sum(round(v * 100) for _, _, p, v in rows if p == px) // 100) + 1 for px in expected}
    assert exact != expected  # some sums of doubles stay below the half
    table = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"]).astype({"ts": "datetime64[us]"})
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for part in range(4):  # last rows first, and parts of a cell in all files
        table[table["event_id"] % 4 == part].iloc[::-1].to_parquet(folder / f"{9 - part}.parquet", index=False)
    found = {r["px"]: (r["t"], r["v"]) for r in fx.stack(spark, str(tmp_path)).collect()}
    assert found == {px: (2, v) for px, v in expected.items()}


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """(events by id, folder of them split over files): every cell of 40 pixels x 30 days ends in .50."""
    rng = random.Random(5)
    rows = []
    for px in range(40):
        for day in range(1, 31):
            cents = [rng.randrange(1, 6000) for _ in range(11)]
            cents[5] += (150 - sum(cents)) % 100
            rows += [(len(rows) + i, datetime.datetime(2024, 1, day, i), px, c / 100) for i, c in enumerate(cents)]
    table = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "value"]).astype({"ts": "datetime64[us]"})
    folder = tmp_path_factory.mktemp("halves")
    (folder / "events.parquet").mkdir()
    for part in range(4):  # as above
        table[table["event_id"] % 4 == part].iloc[::-1].to_parquet(folder / "events.parquet" / f"{9 - part}.parquet", index=False)
    return table, str(folder)


@pytest.mark.parametrize("name", ON_THE_STACK)
def test_query_on_a_split_table_matches_its_sql_on_one_thread(spark, halves, name):
    events, folder = halves
    con = duckdb.connect(config={"threads": 1})  # with several the statement adds in no fixed order
    con.register("events", events)
    expected = con.execute(entry.oracle_sql()[name]).df()
    own = entry.queries()[name](spark, folder).toPandas()
    assert sorted(own.columns) == sorted(expected.columns)
    assert rows_of(own) == rows_of(expected)

"""Variants of fingerprints are made and shuffled once, and buckets are runs over any batches."""

from itertools import combinations

import numpy as np
import pytest

from voxmill.llm import simhash


@pytest.mark.parametrize("rows, paired_bucket", [(10_000, 256), (7, 256), (7, 3), (1, 3)])
def test_variants_are_made_once_and_runs_cross_batches(spark, monkeypatch, rows, paired_bucket):
    rng = np.random.default_rng(2)
    values = set(map(int, rng.integers(0, 1 << 62, 30)))
    for value in list(values)[:10]:
        values |= {value ^ (1 << int(b)) for b in rng.choice(64, 3, replace=False)}
    values |= {sum(1 << int(b) for b in rng.choice(32, 2, replace=False)) for _ in range(20)}
    made, plain = spark.sparkContext.accumulator(0), simhash.deletion_variants

    def counted(points):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return plain(points).mapInArrow(run, "fp long, key long")

    monkeypatch.setattr(simhash, "deletion_variants", counted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        points = spark.createDataFrame([(v,) for v in values], "fp long")
        links = [tuple(r) for r in simhash.fingerprint_links(points, paired_bucket).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert made.value == 64 * len(values)
    assert all((a ^ b).bit_count() <= simhash.MAX_BITS or paired_bucket == 3 for a, b in links)

    def classes(pairs):
        label = {v: v for v in values}
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = {v: low if own == high else own for v, own in label.items()}
        return label

    assert classes(links) == classes((a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= simhash.MAX_BITS)

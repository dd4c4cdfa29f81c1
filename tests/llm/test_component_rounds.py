"""Rounds of components: both uses of a step share its shuffles, and no files of a round are left."""

import os

from voxmill.llm import components
from voxmill.operators import store


def test_uses_of_a_step_share_its_shuffles_and_nothing_is_left(spark, monkeypatch):
    plans, following = [], store.Rounds.next

    def noted(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return following(self, df)

    monkeypatch.setattr(store.Rounds, "next", noted)
    before = set(os.listdir(store.shared_folder(spark)))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # a plan that shows what it shares
    old = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a long, b long")
        found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert found == {i: 0 for i in range(10)} | {20: 20, 21: 20}
    assert len(plans) > 2 and all("ReusedExchange" in plan for plan in plans[1:])
    assert {name for name in set(os.listdir(store.shared_folder(spark))) - before if name.startswith("voxmill-")} == set()

"""What is added to a registry takes part."""

import pytest
from pyspark.sql import functions as F

from setloom import registries
from setloom.model import SEVEN_MODELS
from setloom.operators import cache, picks
from setloom.plans import daily
from setloom.sources import draws as source

SF = "/root/testdata/sf0.001"


def test_an_added_metric_is_in_the_matrix(spark, monkeypatch):
    own = registries.Registry("metric")
    own.update(registries.METRICS)
    monkeypatch.setattr(cache, "METRICS", own)

    @own.add("unseen")
    def unseen():
        return F.to_json(F.struct(F.count_if(F.col("count") == 0).alias("numbers")))

    rows = cache.metric_matrix(source.draws(spark, SF), [50])
    assert {r["metric"] for r in rows.collect()} == {*registries.METRICS, "unseen"}
    assert all(r["payload"].startswith('{"numbers":') for r in rows.filter("metric = 'unseen'").collect())
    with pytest.raises(ValueError, match="already"):
        own.add("unseen")(unseen)


def test_an_added_model_is_scored(spark, monkeypatch):
    monkeypatch.setattr("setloom.model.SEVEN_MODELS", dict(SEVEN_MODELS))
    weights = dict.fromkeys(SEVEN_MODELS["standard"], 0.0) | {"frequency": 1.0}
    registries.add_model("plain", weights)
    rows = cache.score_matrix(source.draws(spark, SF), [50], ["plain"])
    assert rows.count() == 47 and rows.filter("total <> get_json_object(parts, '$.frequency')").isEmpty()
    for name, w in (("plain", weights), ("other", {"frequency": 1.0}), ("other", weights | {"missing": 0.5})):
        with pytest.raises(ValueError):
            registries.add_model(name, w)


def test_an_added_strategy_is_picked(spark, monkeypatch, tmp_path):
    own = registries.Registry("strategy")
    own["C"] = registries.STRATEGY_PICKS["C"]
    own.add("E")(lambda given: picks.random_picks(given.draws.sparkSession, 2, given.seed + 1))
    monkeypatch.setattr(daily, "STRATEGY_PICKS", own)
    run = daily.Run(spark, f"file://{tmp_path}", made={"draws": source.draws(spark, SF)})
    assert sorted(r["strategy"] for r in daily._recommend(run).collect()) == ["C", "E", "E"]

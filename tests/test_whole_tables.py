"""Queries run over whole tables: no subsets of ids."""

from tidemark.plans import catalogue


def test_every_order_is_a_session(spark):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert catalogue.queries()["f2_sessions"](spark, sf).count() == orders
    assert catalogue.queries()["j9_decision_points"](spark, sf).count() == orders


def test_every_pair_has_its_cost(spark):
    sf = "/root/testdata/sf0.001"
    n = {name: catalogue.queries()[name](spark, sf).count() for name in ("p10_mean_gap", "p11_banded_dtw", "p14_waveform_cost")}
    assert len(set(n.values())) == 1

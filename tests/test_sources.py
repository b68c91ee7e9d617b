import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark import schemas
from tidemark.sources import generator, scans, sinks, waves

SMALL = StructType([StructField("a", LongType()), StructField("b", StringType())])


def test_csv_and_missing_file(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([(1, "x")], SMALL), str(tmp_path / "c"), ["b", "a", "extra"], single=True)
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == [("x", "1", None)]
    assert scans.csv_table(spark, str(tmp_path / "none"), SMALL).count() == 0


def test_broken_and_blank_lines(spark, tmp_path):
    (tmp_path / "j").write_text('{"a": 1, "b": "x", "c": 3}\n\n{"a": 2\n{"a": 3, "b": null}\n')
    assert [tuple(r) for r in scans.json_lines(spark, str(tmp_path / "j"), SMALL).collect()] == [(1, "x"), (3, None)]
    assert scans.head(spark, str(tmp_path / "j"), SMALL, 1).count() == 1
    assert [r.a for r in scans.json_lines(spark, str(tmp_path / "j"), SMALL, F.col("a") > 1).collect()] == [3]


def test_documents_and_retention(spark, tmp_path):
    sinks.write_document(spark, {"mode": "m", "z": 1}, str(tmp_path / "d"))
    text = spark.read.text(str(tmp_path / "d")).first()[0]
    assert json.loads(text)["config_hash"] == sinks.config_hash({"z": 1, "mode": "m"})
    runs = spark.createDataFrame([(m, f"run{i}") for m in "ab" for i in range(4)], "mode string, run_id string")
    kept, gone = sinks.retained(runs, 3)
    assert kept.count() == 6 and {r.run_id for r in gone.collect()} == {"run0"}


def test_history(spark, tmp_path):
    h = sinks.History(spark, str(tmp_path / "h"), most=3)
    assert [h.add("r", {"k": i}) for i in range(3)] == ["r", "r_2", "r_3"]
    h.add("s", {}, " note " + "x" * 400)
    assert [r.run_id for r in h.entries().collect()] == ["s", "r_3", "r_2"]
    assert len(h.entries().first().note) == 300 and h.annotate("r_2", "seen") and not h.annotate("nobody", "")
    h.clear()
    assert h.entries().count() == 0


def test_response_of_a_charger():
    pattern = [0, 24, 6, 24, 6, 24]
    slow, fast = waves.response(pattern, ramp=1.0), waves.response(pattern, ramp=10.0)
    assert len(slow) == 360 and np.diff(slow).max() <= 1.15 and np.diff(fast).max() >= 9.8
    assert abs(np.diff(slow).min() + 1) <= 0.15 and abs(np.diff(fast).min() + 4) <= 0.15
    assert np.flatnonzero(waves.response([0, 10, 20, 6, 8, 12], 15) > 0)[0] == 75
    assert np.flatnonzero(waves.response([0, 10, 20, 6, 8, 12], 30) > 0)[0] == 90
    assert waves.response([0, 10, 20, 6, 8, 12])[-1] == round(12 - (0.0221 * 12 + 0.2831), 1)


def test_codebooks():
    rng = np.random.RandomState(1)
    book = generator.codebook(20, rng)
    assert book.shape == (20, 6) and len(np.unique(book, axis=0)) == 20 and (book[:, 0] == 0).all()
    assert np.abs(np.diff(book[:, 1:], axis=1)).min() >= 4 and all(len(set(p[1:])) == 5 for p in book.tolist())
    plain = generator.random_codebook(20, np.random.RandomState(1))
    assert sorted(map(tuple, plain)) == list(map(tuple, plain))
    wide = generator.reshaped(plain, 8, 50, np.random.RandomState(2))
    assert wide.shape == (50, 8) and len(np.unique(wide[:20], axis=0)) == 20


def test_admission_never_shares_a_slot():
    rng = np.random.RandomState(3)
    arrivals, lengths = np.sort(rng.uniform(0, 1_000, 200)), rng.randint(50, 200, 200)
    slot = generator.admitted(arrivals, lengths, 7, rng)
    for s in range(7):
        own = np.flatnonzero(slot == s)
        assert (arrivals[own][1:] >= (arrivals[own] + lengths[own])[:-1]).all()
    for i in np.flatnonzero(slot < 0):
        assert ((arrivals[:i] + lengths[:i] > arrivals[i]) & (slot[:i] >= 0)).sum() == 7


def test_scenarios_repeat(spark):
    s = generator.Scenario(sessions=30, slots=8, patterns=10, heterogeneous=True)
    a, b = (generator.scenarios(spark, [7, 8], s, "sessions") for _ in range(2))
    assert a.schema == schemas.SESSIONS and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert generator.scenarios(spark, [7], s, "slot_intervals").count() + generator.scenarios(spark, [7], s, "blocked").count() == 30
    t = generator.unobserved(generator.scenarios(spark, [7], s, "telemetry"))
    assert t.where("ingest_s < event_s").count() == 0
    same = t.where("ingest_s is not null").groupBy("ev_idx", "measurement_id").agg(F.max(F.col("ingest_s") - F.col("event_s")).alias("d"))
    assert same.agg(F.max("d")).first()[0] <= 10
    with pytest.raises(ValueError):
        generator.Scenario(loss=2)


def test_measurement_copies_share_their_delay():
    s = generator.Scenario(sessions=2, slots=2, patterns=4, delay_mean=50, delay_std=0, delay_most=60, loss=0)
    t = generator.make(1, s)["telemetry"]
    own = t[(t.ev_idx == 0) & (t.measurement_id == 0)]
    assert len(own) == 6 and np.allclose(own.ingest_s, own.event_s.min() + 50)


def test_slot_grid(spark):
    busy = spark.createDataFrame([(1, 10, 20, [1.0, 2.0, 3.0]), (1, 15, 30, [9.0])], "slot long, st long, et long, wave array<double>")
    points = spark.createDataFrame([(1, t) for t in (5, 10, 11, 12, 14, 16, 31)], "slot long, t long")
    got = {r.t: r.value for r in waves.slot_grid(points, busy, 8).collect()}
    assert got == {5: 0, 10: 0, 11: 1, 12: 2, 14: 1, 16: 9, 31: 0}


def test_replay(spark):
    from tidemark.config import MATCHERS
    from tidemark.plans.experiment import replay

    got = replay(spark, [3], generator.Scenario(sessions=25, slots=8, patterns=10), [MATCHERS["time_only"], MATCHERS["single_only"]]).collect()
    acc = {r.algorithm_id: r.accuracy for r in got}
    assert len(got) == 2 and acc["single_only"] >= 0.9 and all(r.unmatched == 0 for r in got)


def test_meter_reads_the_slot_later_and_the_pattern_goes_on():
    """Without gain, bias and noise the value of second x is the slot's current 5 s and the delay later, of the pattern issued again."""
    s = generator.Scenario(sessions=6, slots=6, patterns=6, loss=0, delay_std=0, delay_mean=0, period=5)
    made = generator.make(5, s)
    for r in made["sessions"].itertuples():
        wave = waves.response(r.pattern)
        own = made["telemetry"][made["telemetry"].ev_idx == r.ev_idx]
        at = (own.event_s - r.arrival_s).to_numpy().astype(int)
        later = at + 5 + r.sensor_delay_s
        # gain, bias and noise move a value by less than this
        ideal = np.where(later <= r.session_len_s, wave[(later - 1) % len(wave)], 0.0)
        inside = (at >= 0) & (at <= 360)
        assert np.abs(own.value.to_numpy() - ideal)[inside].max() < 0.12 * 30 + 3
        assert np.corrcoef(own.value.to_numpy()[inside], ideal[inside])[0, 1] > 0.99
    assert (made["sessions"].sensor_noise_std_a == 0.20).all()


def test_blocked_reasons_follow_the_remaining_time():
    s = generator.Scenario(sessions=400, slots=5, patterns=6, last_arrival=4_000)
    blocked = generator.make(9, s)["blocked"]
    assert len(blocked) and set(blocked.reason) <= set(generator.BLOCKED)


def test_separated_codebook_keeps_its_demands():
    book, rungs, given_up = generator.separated_codebook(4, np.random.RandomState(4), apart=31)
    points = book[:, 1:]
    assert book.shape == (4, 6) and (book[:, 0] == 0).all() and not given_up
    apart = np.abs(points[:, None] - points[None]).sum(axis=2)[np.triu_indices(4, 1)]
    assert apart.min() >= (31 if rungs == 0 else 29)
    assert np.diff(np.sort(points, axis=1), axis=1).min() >= 2 and points.min() >= 6 and points.max() <= 30
    again, _, _ = generator.separated_codebook(4, np.random.RandomState(4), apart=31)
    assert (again == book).all()
    # a narrow band can't hold so many patterns apart: they are random and different
    narrow, rungs, given_up = generator.separated_codebook(60, np.random.RandomState(4), low=6, high=11, pool=200)
    assert given_up and rungs > 0 and len(np.unique(narrow, axis=0)) == 60 and narrow[:, 1:].max() <= 11
    with pytest.raises(ValueError):
        generator.separated_codebook(3, np.random.RandomState(4), low=6, high=9)


def test_demands_are_relaxed_in_order():
    rungs = list(generator.relaxed(3, 7, 33))
    assert rungs == [(3, 7, 33), (3, 7, 31), (3, 7, 29), (3, 6, 29), (2, 6, 33), (2, 6, 31), (2, 6, 29)]

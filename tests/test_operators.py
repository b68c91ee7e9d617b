"""Small cases worked out by hand, and plain versions of what the operators do."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import MATCHERS, BayesConfig, CostWeights, RuntimeConfig, matchers
from tidemark.functions import columns as col
from tidemark.functions import kernels
from tidemark.operators import align, analysis, assign, bayes, gate, metrics, ranking, timeline


def test_backward_as_of(spark):
    series = spark.createDataFrame([(1, 10, 7.0), (1, 20, 9.0)], "k int, t int, v double")
    points = spark.createDataFrame([(1, 0), (1, 10), (1, 15), (2, 15)], "k int, t int")
    got = {(r.k, r.t): r.v for r in align.as_of(points, series, ["k"], "t", "v", 0.0).collect()}
    assert got == {(1, 0): 0, (1, 10): 7, (1, 15): 7, (2, 15): 0}


def test_two_levels_of_grid(spark):
    # the grid begins ten before the arrival; values 5 at the arrival and 6 thirty later; first six points are 0
    series = spark.createDataFrame([(1, 10, 5.0), (1, 40, 6.0)], "k int, t int, v double")
    coarse = spark.createDataFrame([(1, t) for t in (0, 30, 60)], "k int, t int")
    fine = spark.createDataFrame([(1, t) for t in range(0, 61, 5)], "k int, t int")
    held = align.as_of(coarse, series, ["k"], "t", "v", 0.0)
    got = [r.v for r in align.as_of(fine, held, ["k"], "t", "v", 0.0).orderBy("t").collect()]
    assert got[:6] == [0.0] * 6 and got[6] == 5.0 and got[12] == 6.0


def test_visibility_is_masked_then_carried(spark):
    rows = [(1, 0, 1.0, 5), (1, 1, 2.0, 50), (1, 2, 3.0, None), (1, 3, 4.0, 20)]
    df = spark.createDataFrame(rows, "k int, i int, v double, ingest int")
    got = [r.seen for r in align.visible(df, ["k"], "i", "v", "ingest", F.lit(30)).orderBy("i").collect()]
    assert got == [1.0, 1.0, 1.0, 4.0]
    none = align.visible(df, ["k"], "i", "v", "ingest", F.lit(0)).where("seen is not null")
    assert none.count() == 0


def test_blocks_are_ready_with_their_last_received(spark):
    delays = [1, 2, 30, 4, 5, 6, 7, 8, 9, None, 11, 12, 13]
    rows = [(1, 5 * i, float(5 * i), None if d is None else 5 * i + d) for i, d in enumerate(delays)]
    df = spark.createDataFrame(rows, "k int, t int, v double, ingest int")
    got = {r.block: r for r in align.blocks(df, ["k"], "t", F.lit(0), 30, "v", "ingest").collect()}
    assert got[0].ready == 40 and got[1].ready == 67 and got[2].ready == 73
    assert got[0]["mean"] == 12.5 and got[2]["mean"] == 60.0


def loop(sessions, c):
    """The tick loop, point by point: what the closed form must give."""
    base = min(s[1] for s in sessions)
    points = {s[1] for s in sessions} | {s[3] for s in sessions}
    end = max(points) + c.window + c.bound + c.tick
    points |= set(range(base, end, c.tick))
    out = {}
    for now in sorted(points):
        for ev, arrival, start, stop in sessions:
            if ev in out or now < arrival:
                continue
            ready = min(start + c.window, stop) + c.bound
            if stop >= ready and now >= ready:
                out[ev] = (now, timeline.WATERMARK)
            elif stop < ready and now >= stop:
                out[ev] = (now, timeline.EARLY_END)
    return out


def test_decisions_agree_with_the_tick_loop(spark):
    rng = random.Random(1)
    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=60)
    rows = []
    for ev in range(200):
        arrival = rng.randrange(2_000)
        rows.append((ev, arrival, arrival + rng.randint(-20, 20), arrival + rng.randint(25, 200)))
    df = spark.createDataFrame(rows, "ev long, arrival long, start_est long, session_end long")
    got = {r.ev: (r.decision_ts, r.reason) for r in timeline.decisions(df, c).collect()}
    assert got == loop(rows, c)


@pytest.mark.parametrize("margin", [20, 0])
def test_gate_agrees_with_probing(spark, margin):
    rng = random.Random(2)
    c = RuntimeConfig(window=60, bound=10, margin=margin, bucket=60)
    decided = [(ev, t, t + rng.randint(-30, 40)) for ev in range(40) for t in [rng.randrange(1_000)]]
    busy = [(rng.randrange(6), a, a + rng.choice([0, 1, 2, 3, 30, 120])) for a in (rng.randrange(1_100) for _ in range(120))]
    d = spark.createDataFrame(decided, "ev long, effective_end long, decision_ts long")
    iv = spark.createDataFrame(busy, "slot long, st long, et long")
    want = set()
    for ev, t, now in decided:
        hi = min(t + margin, now)
        lo = min(t - margin, hi) if margin else hi
        probes = [hi] if lo >= hi else range(lo, hi + 1, c.tick)
        want |= {(ev, s) for s, a, b in busy for p in probes if a <= p <= b}
    got = {(r.ev, r.slot) for r in gate.candidates(d, iv, c).collect()}
    assert got == want
    every = gate.with_fallback(d, gate.candidates(d, iv, c), iv)
    assert every.select("ev").distinct().count() == 40


def slow_dtw(x, y, band):
    n = len(x)
    d = np.full((n + 1, n + 1), 1e18)
    d[0, 0] = 0
    for i, j in itertools.product(range(1, n + 1), repeat=2):
        if abs(i - j) <= band:
            d[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[n, n]


def slow_path_dtw(x, y):
    x, y = x.astype(np.float32).astype(float), y.astype(np.float32).astype(float)
    d = np.full((len(x) + 1, len(y) + 1), np.inf)
    d[0, 0] = 0
    for i, j in itertools.product(range(1, len(x) + 1), range(1, len(y) + 1)):
        d[i, j] = abs(x[i - 1] - y[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    i, j, steps = len(x), len(y), 0
    while i or j:
        steps += 1
        back = [(d[i - 1, j - 1], 0, i - 1, j - 1)] * bool(i and j) + [(d[i - 1, j], 1, i - 1, j)] * bool(i) + [(d[i, j - 1], 2, i, j - 1)] * bool(j)
        _, _, i, j = min(back)
    return d[-1, -1] / steps


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 14), st.integers(0, 10_000))
def test_warping_kernels(n, seed):
    rng = np.random.default_rng(seed)
    x, y = (np.round(rng.normal(0, 2, (4, n))) for _ in range(2))
    assert np.allclose(kernels.banded_dtw(x, y, 3), [slow_dtw(a, b, 3) for a, b in zip(x, y, strict=True)])
    assert np.allclose(kernels.path_dtw(x, y), [slow_path_dtw(a, b) for a, b in zip(x, y, strict=True)])
    assert np.allclose(kernels.banded_dtw(x, x, 3), 0)


def test_segments_past_the_end_and_shared_points():
    v = np.arange(8.0)[None]
    assert kernels.segment_medians(v, 3, 4).tolist() == [[1.0, 4.0, 6.5, 3.5]]
    out = kernels.over_pairs([[1, None, 3, 4], [1, 2, 3, 4]], [[1, 2, np.nan, 4], None], ["n"], lambda e, s: {"n": np.full(len(e), e.shape[1])}, 2)
    assert out["n"].tolist()[0] == 2 and np.isnan(out["n"][1])
    assert kernels.over_pairs([[1, None]], [[1, 2]], ["n"], lambda e, s: {"n": e[:, 0]}, 2)["n"].isna().all()
    assert kernels.correlations(np.ones((1, 5)), np.arange(5.0)[None]).tolist() == [0.0]


def test_two_prefix_cost(spark):
    from tidemark.config import MATCHERS
    from tidemark.operators.matchers import costed, tie_break

    rng = np.random.default_rng(3)
    rows = [(0, r, 10 + c, r, c, rng.uniform(0, 30, 20).tolist(), rng.uniform(0, 30, 20).tolist(), 0.0) for r in range(4) for c in range(3)]
    pairs = spark.createDataFrame(rows, "batch long, row long, slot long, ri int, cj int, e array<double>, s array<double>, delta double")
    cost = lambda df, name: {(r.row, r.slot): r.x for r in costed(df, MATCHERS[name]).select("row", "slot", (F.col("cost") - tie_break()).alias("x")).collect()}
    both, whole = cost(pairs, "two_prefix_greedy"), cost(pairs, "single_only")
    first = cost(pairs.withColumn("e", F.slice("e", 1, 12)).withColumn("s", F.slice("s", 1, 12)), "single_only")
    assert all(np.isclose(both[k], (first[k] + whole[k]) / 2) for k in both) and len(both) == 12


def test_rows_without_an_allowed_slot(spark):
    edges = spark.createDataFrame([(1, 0, 5, 1.0), (1, 1, 5, None), (1, 1, 6, None)], "batch long, row long, slot long, cost double")
    got = {r.row: (r.slot, r.cost, r.fallback) for r in assign.assigned(edges, "greedy").collect()}
    assert got == {0: (5, 1.0, False), 1: (None, None, True)}
    got = {r.row: (r.slot, r.cost, r.fallback) for r in assign.assigned(edges, "greedy", last_resort=True).collect()}
    assert got == {0: (5, 1.0, False), 1: (5, 1e9, True)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10_000))
def test_cheapest_matching(rows, slots, seed):
    cost = np.random.default_rng(seed).integers(0, 20, (rows, slots)).astype(float)
    r, c = assign.least_cost(cost)
    assert len(r) == min(rows, slots) == len(set(r)) == len(set(c))
    few, many = (cost, range(slots)) if rows <= slots else (cost.T, range(rows))
    best = min(sum(few[i, j] for i, j in enumerate(p)) for p in itertools.permutations(many, few.shape[0]))
    assert np.isclose(cost[r, c].sum(), best)


def batch(costs):
    return pd.DataFrame([(1, r, s, c) for (r, s), c in costs.items()], columns=["batch", "row", "slot", "cost"])


def test_conflict_goes_to_the_row_that_loses_more():
    b = batch({(0, 20): 1.0, (0, 21): 1.5, (1, 20): 1.0, (1, 21): 7.0})
    for solve in (assign.optimal, assign.greedy):
        assert dict(zip(solve(b)["row"], solve(b)["slot"], strict=True)) == {0: 21, 1: 20}


def test_forbidden_pairs_fall_back(spark):
    df = spark.createDataFrame([(1, 0, 10, 1.0), (1, 1, 10, 2.0), (1, 1, 11, None), (2, 5, 10, None)], "batch int, row int, slot int, cost double")
    got = {r.row: (r.slot, r.cost, r.fallback) for r in assign.assigned(df, "optimal").collect()}
    # a row without an allowed slot stays unmatched
    assert got == {0: (10, 1.0, False), 1: (10, 2.0, True), 5: (None, None, True)}


def plain_posterior(delta, c1, c2, cfg):
    def norm(p):
        p = np.maximum(p, cfg.eps)
        return p / p.sum()

    def like(c):
        mad = np.median(np.abs(c - np.median(c)))
        scale = mad if mad > 1e-6 else c.std() if c.std() > 1e-6 else np.ptp(c) if np.ptp(c) > 1e-6 else 1.0
        return norm(np.exp(-np.minimum(cfg.beta * (c - c.min()) / scale, 80)))

    scale = max(1.0, np.quantile(delta, 0.75))
    prior = norm(cfg.mix * norm(np.exp(-cfg.alpha * delta / scale)) + (1 - cfg.mix) / len(delta))
    post = np.full(len(delta), 1 / len(delta))
    for c, (_, power) in zip((c1, c2), cfg.stages, strict=True):
        s = cfg.carry * np.log(post) + power * np.log(prior) + np.log(like(c))
        post = np.exp(s - s.max())
        post /= post.sum()
    return post


def test_posterior(spark):
    rng = np.random.default_rng(3)
    rows = [(r, s, float(rng.integers(0, 30)), float(rng.random()), float(rng.random()) if r != 2 else 0.5) for r in range(4) for s in range(r + 1)]
    df = spark.createDataFrame(rows, "row int, slot int, delta double, c1 double, c2 double")
    got = {(r.row, r.slot): r.post2 for r in bayes.posterior(df, ["row"], "delta", ["c1", "c2"]).collect()}
    for r in range(4):
        own = [x for x in rows if x[0] == r]
        want = plain_posterior(*(np.array([x[k] for x in own]) for k in (2, 3, 4)), BayesConfig())
        assert np.allclose([got[r, x[1]] for x in own], want)


def test_pattern_distances(spark):
    df = spark.createDataFrame([([0.0, 6.0, 18.0, 28.0, 15.0, 10.0], [0.0, 8.0, 18.0, 14.0, 19.0, 24.0])], "p array<double>, q array<double>")
    assert df.select(col.l1("p", "q")).first()[0] == 34
    t = spark.createDataFrame([("0|12| |7|",)], "t string")
    assert t.select(col.from_pattern_text("t")).first()[0] == [0, 12, 7]


def test_signed_rank_and_holm(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, -4, 5, 6, 0, 7)], "diff double")
    r = analysis.signed_rank(df, []).first()
    assert r.n == 7 and r.w == 4.0 and abs(r.p - 0.0910) < 1e-3
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "t string, p double")
    assert {x.t: round(x.p_holm, 6) for x in analysis.holm(tests).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_student_quantiles(spark):
    got = spark.range(1, 200).select("id", metrics.t975(F.col("id")).alias("t")).collect()
    t = {r.id: r.t for r in got}
    assert abs(t[14] - 2.1448) < 1e-4 and abs(t[19] - 2.0930) < 1e-4 and abs(t[100] - 1.984) < 2e-3
    assert all(t[k] > t[k + 1] for k in range(1, 198))


def test_empty_runs(spark):
    empty = spark.createDataFrame([], "slot long, gt_slot long, cost double, arrival long, decision_ts long, reason string")
    row = metrics.run_metrics(empty, F.lit(5)).first()
    assert row.total_evs == 0 and row.accuracy is None and row.blocked_ratio == 1.0


def test_registry():
    assert len(MATCHERS) == 15
    assert [m.name for m in matchers(["proposed_full", "single_only", "time_only"])] == ["single_only", "time_only"]
    with pytest.raises(ValueError):
        matchers(["unknown"])
    with pytest.raises(ValueError):
        RuntimeConfig(window=0)
    assert CostWeights().step == 0.4


def test_time_costs_agree_with_all_intervals(spark):
    rng = random.Random(5)
    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    busy = [(rng.randrange(6), (t := rng.randrange(-300, 900)), t + rng.choice([0, 3, 40, 400])) for _ in range(60)]
    asked = [(ev, rng.randrange(-400, 1_400), rng.randrange(-400, 1_400)) for ev in range(80)]
    # times that meet starts and ends, an interval twice, a slot without intervals
    asked += [(100 + i, st, et) for i, (_, st, et) in enumerate(busy)]
    iv = spark.createDataFrame(busy + busy[:3], "slot long, st long, et long")
    d = spark.createDataFrame(asked, "ev long, effective_end long, start_est long")
    edges = d.select("ev").crossJoin(spark.range(7).select(F.col("id").alias("slot")))
    want = {}
    for ev, te, start in asked:
        for slot in range(6):
            own = [(st, et) for s, st, et in busy if s == slot]
            if own:
                want[ev, slot] = (min(max(st - te, te - et, 0) for st, et in own), min(abs(st - start) for st, _ in own))
    found = gate.time_costs(edges, d, iv, c).collect()
    assert len(found) == len(want) and {(r.ev, r.slot): (r.end_dist, r.start_dist) for r in found} == want
    assert gate.time_costs(edges, d, iv.where("false"), c).count() == 0


@pytest.mark.parametrize("margin", [20, 0])
def test_counts_agree_with_candidates(spark, margin):
    rng = random.Random(11)
    c = RuntimeConfig(window=60, bound=10, margin=margin, bucket=60)
    decided = [(ev, t, t + rng.randint(-30, 40), rng.randrange(8)) for ev in range(80) for t in [rng.randrange(-200, 800)]] + [(80, None, None, 1)]
    busy = [(rng.randrange(6), a, a + rng.choice([-1, 0, 1, 2, 3, 4, 30, 120])) for a in (rng.randrange(-300, 900) for _ in range(150))]
    d = spark.createDataFrame(decided, "ev long, effective_end long, decision_ts long, own long")
    iv = spark.createDataFrame(busy + busy[:5], "slot long, st long, et long")
    pairs = [(r.ev, r.slot) for r in gate.candidates(d, iv, c).collect()]
    got = {r.ev: r.candidates for r in gate.candidate_counts(d, iv, c).collect()}
    assert got == {ev: sum(e == ev for e, _ in pairs) for ev, *_ in decided} and len(set(got.values())) > 3
    own = {r.ev for r in gate.own_in_gate(d, iv, c, "own").collect()}
    assert own == {ev for ev, _, _, s in decided if (ev, s) in pairs} and own


@pytest.mark.parametrize("name", ["j3_truth_in_gate", "a11g_loop_counters", "a15g_candidate_summary", "a16g_candidate_cdf"])
def test_counts_list_no_pairs(spark, monkeypatch, name):
    from tidemark.plans import catalogue

    monkeypatch.setattr(gate, "candidates", None)
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_cheapest_and_rank_agree_with_all_pairs(spark):
    rng = random.Random(13)
    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    decided = [(ev, t - rng.randint(0, 60), t, t + rng.randint(-5, 20), rng.randrange(30)) for ev in range(60) for t in [rng.randrange(-100, 300)]] + [(60, 0, 5_000, 5_010, 1), (61, None, None, None, 1)]
    busy = [(rng.randrange(25), a, a + rng.choice([0, 3, 40])) for a in (rng.randrange(-150, 350) for _ in range(120))]
    d = spark.createDataFrame(decided, "ev long, start_est long, effective_end long, decision_ts long, own long")
    iv = spark.createDataFrame(busy + busy[:5], "slot long, st long, et long")
    costs = gate.time_costs(gate.candidates(d, iv, c), d, iv, c).toPandas().sort_values(["ev", "cost", "slot"])
    want = {ev: (g["slot"].iloc[0], g["cost"].iloc[0], g["cost"].iloc[1] - g["cost"].iloc[0] if len(g) > 1 else None) for ev, g in costs.groupby("ev")}
    assert {r.ev: (r.slot, r.cost, r.margin) for r in ranking.cheapest(d, iv, c).collect()} == want
    own = {ev: slot for ev, *_, slot in decided}
    ranks = {ev: list(g["slot"]).index(own[ev]) + 1 for ev, g in costs.groupby("ev") if own[ev] in set(g["slot"])}
    assert {r.ev: r.candidate_rank for r in ranking.rank_of(d, iv, c, "own").collect()} == ranks and len(ranks) > 3
    assert ranking.cheapest(d, iv.where("false"), c).count() == 0


def _spread(rng, slots):
    decided = [(ev, t - rng.randint(0, 60), t, t + rng.randint(-5, 20)) for ev in range(80) for t in [rng.randrange(-100, 300)]] + [(80, 0, 5_000, 5_010), (81, None, None, None), (82, 10, 50, 20)]
    busy = [(rng.randrange(slots), a, a + rng.choice([0, 3, 40, 90])) for a in (rng.randrange(-150, 350) for _ in range(12 * slots))]
    return decided, busy


def test_lowest_slots_settle_a_question_and_others_get_the_rest(spark, monkeypatch):
    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    decided, busy = _spread(random.Random(29), 40)
    d = spark.createDataFrame(decided, "ev long, start_est long, effective_end long, decision_ts long")
    iv = spark.createDataFrame(busy + busy[:5], "slot long, st long, et long")
    costs = gate.time_costs(gate.candidates(d, iv, c), d, iv, c).toPandas().sort_values(["ev", "cost", "slot"])
    want = {ev: (g["slot"].iloc[0], g["cost"].iloc[0], g["cost"].iloc[1] - g["cost"].iloc[0] if len(g) > 1 else None) for ev, g in costs.groupby("ev")}
    assert {m == 0 for *_, m in want.values()} == {True, False}
    for lowest, few in ((1024, 1), (30, 1), (3, 1000)):
        monkeypatch.setattr(ranking, "LOWEST", lowest)
        monkeypatch.setattr(ranking, "FEW", few)
        linked = {r.ev: (r.start_est, r.slot, r.cost, r.margin) for r in ranking.linked(d, iv, c).collect()}
        assert linked == {ev: (start, *want.get(ev, (None, None, None))) for ev, start, *_ in decided}


def test_settled_questions_price_few_slots(monkeypatch):
    import pandas as pd

    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    held = pd.DataFrame([(s, 0, 100) for s in range(5_000)], columns=["slot", "st", "et"])
    asked = pd.DataFrame([(0, t, t - 20, t + 10) for t in range(60, 90)], columns=ranking.TIMES)
    priced = []
    whole = ranking._priced
    monkeypatch.setattr(ranking, "_priced", lambda a, block, config: priced.append(len(block.slots)) or whole(a, block, config))
    found = ranking._first_two(asked, held, c)
    assert len(found) == 30 and set(found["slot"]) == {0} and set(found["second"]) == {0} and sum(priced) < 100


def test_gate_by_lists_agrees_with_pairs(spark):
    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    decided, busy = _spread(random.Random(31), 30)
    d = spark.createDataFrame(decided, "ev long, start_est long, effective_end long, decision_ts long")
    iv = spark.createDataFrame([*busy, *busy[:5], (None, 0, 90), (3, 70, 60)], "slot long, st long, et long")
    want = sorted(map(tuple, gate.candidates(d, iv, c).collect()), key=str)
    assert sorted(map(tuple, ranking.gated(d, iv, c).collect()), key=str) == want and any(slot is None for _, slot in want)
    assert ranking.gated(d, iv.where("false"), c).count() == 0


def test_gate_query_lists_windows(spark, monkeypatch):
    from tidemark.plans import catalogue

    met, whole = [], gate._met
    monkeypatch.setattr(gate, "_met", lambda w, iv, *more: met.append(iv.where("slot is not null").count()) or whole(w, iv, *more))
    assert catalogue.queries()["j1_candidate_gate"](spark, "/root/testdata/sf0.001").count() > 0
    assert not any(met)


def test_claim_counts_agree_with_claims(spark):
    rng = random.Random(17)
    links = [(ev, rng.randrange(4), t, t + rng.choice([0, 0, 1, 5, 30])) for ev in range(150) for t in [rng.randrange(-60, 60)]] + [(150, 1, None, None)]
    df = spark.createDataFrame(links, "ev long, slot long, decision_ts long, session_end long")
    want = {(a, b, s, d == e) for a, s, d, end in links for b, t, e, _ in links if s == t and d is not None and e is not None and (d, a) < (e, b) and end > e}
    found = analysis.duplicate_claims(df, 7).collect()
    assert len(found) == len(want) and {(r.first_ev, r.later_ev, r.slot, r.same_batch) for r in found} == want
    assert tuple(analysis.claim_counts(df).first()) == (len(want), sum(w[3] for w in want), len({e for w in want for e in w[:2]}))
    assert tuple(analysis.claim_counts(df.where("false")).first()) == (0, 0, 0)


@pytest.mark.parametrize("name", ["m13_independent_best", "w8_best_margin", "w5_rank_of_truth", "a1g_run_metrics", "j15_duplicate_claims", "a21g_duplicate_counters"])
def test_cheapest_lists_no_pairs(spark, monkeypatch, name):
    from tidemark.plans import catalogue

    monkeypatch.setattr(gate, "candidates", None)
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_signed_rank_of_many(spark):
    many = spark.range(3_000_000).select(F.when(F.col("id") % 3 == 0, -2.0).otherwise(1.0).alias("diff"))
    r = analysis.signed_rank(many, []).first()
    n = 3_000_000
    assert r.n == n and r.w == 2_000_000 * 1_000_000.5
    var = n * (n + 1) * (2 * n + 1) / 24 - (1_000_000**3 + 2_000_000**3 - n) / 48
    assert abs(r.z - (r.w - n * (n + 1) / 4) / var**0.5) < 1e-6


def test_z_scores_take_one_mean_an_array(spark):
    import time

    df = spark.range(10).select(F.expr("transform(sequence(1, 600), x -> cast(x * id as double))").alias("v")).unionByName(spark.sql("select cast(array() as array<double>) v union all select null"))
    began = time.time()
    found = [r.z for r in df.select(col.z_scores("v").alias("z")).collect()]
    assert time.time() - began < 15
    assert found[0] == [0.0] * 600 and found[10:] == [[], None]
    assert abs(found[3][0] + 299.5 / ((600**2 - 1) / 12) ** 0.5) < 1e-9


def test_greedy_query_keeps_small_batches(spark, tmp_path):
    from tests import oracle
    from tidemark.plans import catalogue

    v = spark.range(17).where("id not in (11, 13)").select(F.col("id").alias("vec_id"), F.expr("transform(sequence(1, 64), x -> cast((x * (id + 3)) % 17 as float))").alias("embedding"), F.lit(1).alias("label"))
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = oracle.spark_rows(catalogue.queries()["m4_greedy_assignment"](spark, str(tmp_path)))
    assert got == oracle.duckdb_rows(con, catalogue.oracle_sql()["m4_greedy_assignment"])
    assert any("~" in row for row in got[1])


def test_listed_pairs_agree_with_joins(spark):
    rng = random.Random(19)
    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    decided = [(ev, t - rng.randint(0, 60), t, t + rng.randint(-5, 20)) for ev in range(60) for t in [rng.randrange(-100, 300)]] + [(60, 0, 5_000, 5_010), (61, None, None, None)]
    busy = [(rng.randrange(25), a, a + rng.choice([0, 3, 40])) for a in (rng.randrange(-150, 350) for _ in range(120))] + [(None, 40, 60)]
    d = spark.createDataFrame(decided, "ev long, start_est long, effective_end long, decision_ts long")
    iv = spark.createDataFrame(busy, "slot long, st long, et long")
    costs = gate.time_costs(gate.candidates(d, iv, c), d, iv, c)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert plain(ranking.listed(d, iv, c)) == plain(costs.select("ev", "slot", "end_dist", "cost"))
    assert plain(ranking.ranked(d, iv, c)) == plain(gate.ranked(costs).select("ev", "slot", "candidate_rank"))
    assert plain(gate.gated_or_all(d, iv, c)) == plain(gate.with_fallback(d, gate.candidates(d, iv, c), iv))


@pytest.mark.parametrize("name", ["j2_gate_fallback", "j8_time_cost", "w4_candidate_rank"])
def test_pairs_are_not_joined(spark, monkeypatch, name):
    from tidemark.plans import catalogue

    for joined in ("candidates", "with_fallback", "time_costs"):
        monkeypatch.setattr(gate, joined, None)
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_gate_or_all_by_lists_agrees_with_pairs(spark):
    rng, c = random.Random(37), RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    decided = [(ev, t - rng.randint(0, 60), t, t + rng.randint(-45, 20)) for ev in range(80) for t in [rng.randrange(-100, 300)]] + [(80, 0, 5_000, 5_010), (81, None, None, None), (82, 400, 10, 15)]
    busy = [(rng.randrange(25), a, a + rng.choice([0, 3, 40])) for a in (rng.randrange(-150, 350) for _ in range(120))] + [(None, 40, 60), (77, 10, 5), (78, None, None), (1, 9_000, 9_001)]
    d = spark.createDataFrame(decided, "ev long, start_est long, effective_end long, decision_ts long")
    iv = spark.createDataFrame(busy, "slot long, st long, et long")
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = plain(gate.with_fallback(d, gate.candidates(d, iv, c), iv))
    assert plain(ranking.gated_or_all(d, iv, c)) == want and {g for *_, g in want} == {True, False}
    assert ranking.gated_or_all(d, iv.where("false"), c).count() == ranking.gated_or_all(d.where("false"), iv, c).count() == 0


def test_fallback_query_meets_no_single_intervals(spark, monkeypatch):
    from tidemark.plans import catalogue

    monkeypatch.setattr(gate, "_met", None)
    assert catalogue.queries()["j2_gate_fallback"](spark, "/root/testdata/sf0.001").count() > 0


def test_priced_pairs_are_sent_in_bounded_batches(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    c = RuntimeConfig(window=60, bound=10, margin=20, bucket=50)
    monkeypatch.setattr(ranking, "PAIRS", 64)
    monkeypatch.setattr(ranking, "KEPT", 100)
    held = pd.DataFrame({"slot": range(40), "st": [k % 7 for k in range(40)], "et": [90 + k for k in range(40)]}).astype("Int64")
    asked = pa.RecordBatch.from_pydict({"ev": list(range(50)), "start_est": [k // 20 for k in range(50)], "effective_end": [60] * 50, "_lo": [40] * 50, "_hi": [70] * 50})
    found = list(ranking._cost_each(asked, ranking.Slots(held, c)))
    assert max(map(len, found)) <= 64 + 40 and sum(map(len, found)) == 50 * 40
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert sorted(rows) == [(ev, s, 0, 0.1 * abs(s % 7 - ev // 20)) for ev in range(50) for s in range(40)]


def test_cost_query_gathers_no_lists(spark, monkeypatch):
    from tidemark.plans import catalogue

    monkeypatch.setattr(ranking, "_by_block", None)
    found = catalogue.queries()["j8_time_cost"](spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and found.where("cost != round(cost, 6)").count() == 0


def test_order_by_places_is_that_by_cost():
    import numpy as np

    rng = np.random.default_rng(3)
    for most in (3, 300, 5_000):
        far, late = rng.integers(0, 25, 400).astype(float), rng.integers(0, most, 400).astype(float)
        want = sorted(range(400), key=lambda k: (far[k] + 0.1 * late[k], k))
        assert ranking._by_cost(far, late, 0.1).tolist() == want


def test_rank_query_gathers_no_lists(spark, monkeypatch):
    from tidemark.plans import catalogue

    monkeypatch.setattr(ranking, "_by_block", None)
    assert catalogue.queries()["w4_candidate_rank"](spark, "/root/testdata/sf0.001").count() > 0


def test_gate_query_shuffles_no_lists(spark, monkeypatch):
    from tidemark.plans import catalogue

    monkeypatch.setattr(ranking, "_by_block", None)
    found = catalogue.queries()["j1_candidate_gate"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")] and found.columns == ["ev", "slot"]


def test_a_list_stands_for_few_pairs(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(ranking, "PAIRS", 64)
    held = pd.DataFrame({"slot": range(20), "st": [0] * 20, "et": [90] * 20}).astype("Int64")
    asked = pa.RecordBatch.from_pydict({"ev": list(range(50)), "_lo": [40] * 30 + [900] * 20, "_hi": [70] * 30 + [930] * 20})
    rows = [r for b in ranking._windows(asked, ranking.Slots(held, RuntimeConfig(window=60, bound=10, margin=20, bucket=50))) for r in b.to_pylist()]
    assert max(len(r["evs"]) * len(r["slots"]) for r in rows) <= 64
    assert sorted((ev, s, r["gated"]) for r in rows for ev in r["evs"] for s in r["slots"]) == [(ev, s, ev < 30) for ev in range(50) for s in range(20)]

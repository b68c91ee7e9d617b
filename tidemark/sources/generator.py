"""Reproducible scenarios: codebooks, arrivals, admission, sensing, ingestion. One task makes one scenario; scenarios are independent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources.waves import response

LOW, HIGH = 6, 30
#: Seconds between the charger's samples, the meter's noise in ampere, why a request is blocked.
SAMPLE, NOISE = 5, 0.20
BLOCKED = ("long_session_occupancy_domination", "session_overlap_concentration", "arrival_slot_full")


@dataclass(frozen=True)
class Scenario:
    """What a scenario holds; times in seconds from its beginning."""

    sessions: int = 100
    slots: int = 50
    horizon: int = 43_200
    last_arrival: int = 39_600
    shortest: int = 600
    longest: int = 3_600
    patterns: int = 50
    steps: int = 6
    delay_mean: float = 2.0
    delay_std: float = 1.0
    delay_most: float = 10.0
    loss: float = 0.005
    period: int = 30
    heterogeneous: bool = False
    arrivals: tuple[float, ...] = ()

    def __post_init__(self) -> None:
        if min(self.sessions, self.slots, self.patterns, self.steps - 1, self.period) <= 0:
            raise ValueError("sessions, slots, patterns, steps and period must be positive")
        if not 0 <= self.loss <= 1 or self.shortest > self.longest or self.last_arrival > self.horizon:
            raise ValueError("loss lies in 0..1, shortest below longest, last_arrival below horizon")


def codebook(n: int, rng: np.random.RandomState, steps: int = 6, apart: int = 4, pool: int = 2_000, low: int = LOW, high: int = HIGH) -> np.ndarray:
    """n patterns of zero and steps - 1 different set-points, far from each other.

    Of a random pool, those whose consecutive set-points differ by `apart` at least; if they are too few, by less and less.
    Then again and again the one farthest from all that were chosen.
    """
    draws = np.stack([rng.permutation(np.arange(low, high + 1))[: steps - 1] for _ in range(max(pool, 4 * n))])
    draws = np.unique(draws, axis=0)
    draws = draws[rng.permutation(len(draws))]
    gaps = np.abs(np.diff(draws, axis=1)).min(axis=1)
    while apart > 0 and (gaps >= apart).sum() < n:
        apart -= 1
    draws = draws[gaps >= apart]
    chosen = [0]
    far = np.abs(draws - draws[0]).sum(axis=1)
    while len(chosen) < min(n, len(draws)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.abs(draws - draws[chosen[-1]]).sum(axis=1))
    return np.concatenate([np.zeros((len(chosen), 1), dtype=int), draws[chosen]], axis=1)


def walks(n: int, rng: np.random.RandomState, steps: int, gap: int, step: int, low: int, high: int) -> np.ndarray:
    """Random sequences of different set-points; each is one of the three farthest from the one before.

    Set-points at least `step` from the one before come first, else the farthest; of them those `gap` from all before, if
    there are any. Sequences that break the gap are left out. All sequences grow side by side.
    """
    points = np.arange(low, high + 1)
    out = rng.choice(points, n)[:, None]
    while out.shape[1] < steps - 1:
        away = np.abs(points - out[:, :, None])
        free, last = away.min(axis=1) > 0, away[:, -1]
        enough = free & (last >= step)
        most = np.where(free, last, -1).max(axis=1, keepdims=True)
        choice = np.where(enough.any(axis=1, keepdims=True), enough, free & (last == most))
        wide = choice & (away.min(axis=1) >= gap)
        choice = np.where(wide.any(axis=1, keepdims=True), wide, choice)
        order = np.argsort(np.where(choice, -last, 1), axis=1, kind="stable")
        pick = (rng.random_sample(n) * np.minimum(3, choice.sum(axis=1))).astype(int)
        out = np.column_stack([out, points[order[np.arange(n), pick]]])
    ordered = np.sort(out, axis=1)
    return out[np.diff(ordered, axis=1).min(axis=1) >= gap] if steps > 2 else out


def relaxed(gap: int, step: int, apart: int):
    """(gap, step, apart), less strict each time: the distance by two to 30, the step by one to 6, then the gap by one to 2 with the distance as at first."""
    now = apart
    while True:
        yield gap, step, now
        if now > 30:
            now -= 2
        elif step > 6:
            step -= 1
        elif gap > 2:
            gap, now = gap - 1, apart
        else:
            return


def _features(book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    full = np.concatenate([np.zeros((len(book), 1)), book], axis=1)
    spread = full.std(axis=1, keepdims=True)
    return full, np.where(spread > 1e-6, full - full.mean(axis=1, keepdims=True), 0) / np.maximum(spread, 1e-6), np.diff(full, axis=1)


def separated_codebook(n: int, rng: np.random.RandomState, steps: int = 6, gap: int = 4, step: int = 10, apart: int = 45, pool: int = 3_000, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, int, bool]:
    """(n patterns of zero and steps - 1 set-points, how often the demands were relaxed, whether they were given up).

    Any two patterns are `apart` in l1, set-points of one pattern `gap`, consecutive ones `step` where that goes. From the
    most spread sequence on, always the one whose nearest chosen one is farthest by the proxy distance. If a pool has too
    few, the next one is drawn under weaker demands; at their end the patterns are random.
    """
    if low < 1 or high - low + 1 < max(5, steps - 1):
        raise ValueError("set-points must lie above 0 and be as many as a pattern has, five at least")
    for rungs, (g, s, a) in enumerate(relaxed(gap, step, apart)):
        draws = walks(pool, rng, steps, g, s, low, high)
        if not len(draws):
            continue
        full, z, d = _features(draws)
        at, chosen = int(draws.std(axis=1).argmax()), []
        near, far = np.full(len(draws), np.inf), np.full(len(draws), np.inf)
        while len(chosen) < n:
            chosen.append(at)
            near = np.minimum(near, np.abs(draws - draws[at]).sum(axis=1))
            proxy = np.linalg.norm(z - z[at], axis=1) + 0.05 * np.abs(full - full[at]).mean(axis=1) + 0.02 * np.abs(d - d[at]).mean(axis=1) + 0.01 * np.abs(full.mean(axis=1) - full[at].mean())
            far = np.minimum(far, proxy)
            open_ = near >= max(a, 1)
            if not open_.any():
                break
            at = int(np.where(open_, far, -1).argmax())
        if len(chosen) == n:
            return np.concatenate([np.zeros((n, 1), dtype=int), draws[chosen]], axis=1), rungs, False
    return random_codebook(n, rng, steps, low, high, ordered=False), rungs + 1, True


def random_codebook(n: int, rng: np.random.RandomState, steps: int = 6, low: int = LOW, high: int = HIGH, ordered: bool = True) -> np.ndarray:
    """n different random patterns, in their order or as drawn."""
    seen: dict[tuple, None] = {}
    while len(seen) < n:
        seen.setdefault((0, *rng.permutation(np.arange(low, high + 1))[: steps - 1]), None)
    return np.array(sorted(seen) if ordered else list(seen))


def reshaped(patterns: np.ndarray, steps: int, n: int, rng: np.random.RandomState) -> np.ndarray:
    """Different patterns cut or repeated to `steps`, then as many as `n`: shuffled rounds of the pool, without repeats while they last."""
    wide = np.concatenate([patterns[:, :1], np.tile(patterns[:, 1:], (1, -(-steps // max(1, patterns.shape[1] - 1))))[:, : steps - 1]], axis=1)
    _, first = np.unique(wide, axis=0, return_index=True)
    wide = wide[np.sort(first)]
    rounds = [wide[rng.permutation(len(wide))] for _ in range(-(-n // len(wide)))]
    return np.concatenate(rounds)[:n]


def admitted(arrivals: np.ndarray, lengths: np.ndarray, slots: int, rng: np.random.RandomState) -> np.ndarray:
    """The slot of each request in order of arrival, a random free one, or -1 if none is: a loss system."""
    free_at, out = np.zeros(slots), np.full(len(arrivals), -1)
    for i, (t, n) in enumerate(zip(arrivals, lengths, strict=True)):
        free = np.flatnonzero(free_at <= t)
        if len(free):
            out[i] = free[rng.randint(len(free))]
            free_at[out[i]] = t + n
    return out


def make(scenario_id: int, s: Scenario) -> dict[str, pd.DataFrame]:
    """sessions, slot_intervals, blocked and telemetry of a scenario; the id is its seed."""
    rng = np.random.RandomState(scenario_id % (1 << 32))
    book = codebook(s.patterns, rng, s.steps)
    window = 60 * s.steps
    arrivals = np.sort(np.clip(np.array(s.arrivals, dtype=float) if s.arrivals else rng.uniform(0, s.last_arrival, s.sessions), 0, s.last_arrival)).round()
    # no session outlasts the horizon
    lengths = np.minimum(rng.randint(s.shortest, s.longest + 1, len(arrivals)), (s.horizon - arrivals).astype(int))
    slots = admitted(arrivals, lengths, s.slots, rng)
    used_until, rows, busy, blocked, points = {}, [], [], [], []
    for i, (t, n, slot) in enumerate(zip(arrivals, lengths, slots, strict=True)):
        active = int(((arrivals[:i] + lengths[:i] > t) & (slots[:i] >= 0)).sum())
        if slot < 0:
            # the time that the running sessions still take
            going = (arrivals[:i] + lengths[:i] - t)[slots[:i] >= 0]
            going = going[going > 0]
            long = float((going >= 0.75 * s.longest).mean()) if len(going) else 0.0
            full = active / s.slots
            blocked.append((scenario_id, i, float(t), active, int(n), BLOCKED[0] if long >= 0.6 else BLOCKED[1] if full >= 0.95 else BLOCKED[2], full, long))
            continue
        # the free pattern that is farthest from those in use
        free = [k for k in range(len(book)) if used_until.get(k, -1) <= t] or list(range(len(book)))
        in_use = [k for k in used_until if used_until[k] > t]
        k = max(free, key=lambda p: min((int(np.abs(book[p] - book[q]).sum()) for q in in_use), default=0))
        used_until[k] = t + n
        lag, ramp = (float(rng.uniform(2, 30)), float(rng.uniform(1, 10))) if s.heterogeneous else (None, None)
        delay, gain, bias, noise = int(rng.randint(0, 21)), float(np.clip(rng.normal(1, 0.03), 0.8, 1.2)), float(rng.normal(0, 0.35)), NOISE
        wave = response(book[k], 15.0 if lag is None else lag, ramp=ramp)
        # the meter reads the slot later than it says; the pattern is issued again as long as the session lasts
        at = np.arange(window + 1) + SAMPLE + delay
        seen = np.where(at <= n, wave[(at - 1) % len(wave)], 0.0)
        measured = np.ceil(np.maximum(seen * gain + bias + rng.normal(0, noise, len(seen)), 0) - 1e-9)
        risen = np.flatnonzero(measured >= 1)
        start = float(np.clip(t + (risen[0] if len(risen) else 0) + rng.randint(-20, 21), t - s.period, t + max(s.period, window / 2)))
        e = len(rows)
        rows.append((scenario_id, e, f"ev-{scenario_id}-{e}", int(slot), float(t), start, float(t + n), int(n), book[k].tolist(), delay, gain, bias, noise, lag, ramp))
        busy.append((scenario_id, int(slot), float(t), float(t + n), book[k].tolist(), lag, ramp))
        grid = start + 5 * np.arange(window // 5 + 1)
        taken = np.floor((grid - start) / s.period).astype(int)
        value = measured[np.clip((start + taken * s.period - t).astype(int), 0, window)] * (start + taken * s.period >= t)
        late = np.clip(rng.normal(s.delay_mean, s.delay_std, taken.max() + 1), 0, s.delay_most)
        lost = rng.uniform(size=taken.max() + 1) < s.loss if s.loss > 0 else np.zeros(taken.max() + 1, dtype=bool)
        publish = start + np.arange(taken.max() + 1) * s.period + late
        points.append(pd.DataFrame({"scenario_id": scenario_id, "ev_idx": e, "grid_idx": np.arange(len(grid)), "event_s": grid, "measurement_id": taken, "value": value, "ingest_s": np.where(lost[taken], np.nan, np.maximum(grid, publish[taken]))}))
    frame = lambda data, schema: pd.DataFrame(data, columns=schema.names)
    return {"sessions": frame(rows, schemas.SESSIONS), "slot_intervals": frame(busy, schemas.SLOT_INTERVALS), "blocked": frame(blocked, schemas.BLOCKED), "telemetry": pd.concat(points) if points else frame([], schemas.TELEMETRY)}


_TABLES = {"sessions": schemas.SESSIONS, "slot_intervals": schemas.SLOT_INTERVALS, "blocked": schemas.BLOCKED, "telemetry": schemas.TELEMETRY}


def scenarios(spark: SparkSession, ids: list[int], s: Scenario, table: str) -> DataFrame:
    """One table of many scenarios."""
    seeds = spark.createDataFrame([(i,) for i in ids], "scenario_id long").repartition(max(1, len(ids)), "scenario_id")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = make(int(rows["scenario_id"].iloc[0]), s)[table]
        return out.astype({c: object for c in out.columns if c.startswith(("response", "ingest"))}).where(out.notna(), None)

    return seeds.groupBy("scenario_id").applyInPandas(run, _TABLES[table])


def unobserved(telemetry: DataFrame) -> DataFrame:
    """Telemetry with NaN ingestion as null."""
    return telemetry.withColumn("ingest_s", F.nanvl("ingest_s", F.lit(None)))

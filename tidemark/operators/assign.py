"""One-to-one assignment inside each decision batch."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_cost(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a cheapest one-to-one matching of as many as go; shortest augmenting paths with potentials."""
    if cost.shape[0] > cost.shape[1]:
        cols, rows = least_cost(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        far, by, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        at, col, reach = row, -1, 0.0
        visited = [row]
        while True:
            step = reach + cost[at] - u[at] - v
            better = ~done & (step < far)
            far[better], by[better] = step[better], col
            col = int(np.argmin(np.where(done, np.inf, far)))
            reach = far[col]
            done[col] = True
            if owner[col] < 0:
                break
            at = int(owner[col])
            visited.append(at)
        for k in visited:
            own = np.flatnonzero(owner == k)
            u[k] += reach - (far[own[0]] if k != row else 0.0)
        v[done] -= reach - far[done]
        while col >= 0:
            before = int(by[col])
            owner[col] = owner[before] if before >= 0 else row
            col = before
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


def _dense(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, slots = np.sort(batch["row"].unique()), np.sort(batch["slot"].unique())
    cost = np.full((len(rows), len(slots)), np.inf)
    cost[np.searchsorted(rows, batch["row"]), np.searchsorted(slots, batch["slot"])] = np.where(batch["cost"].isna(), np.inf, batch["cost"])
    return rows, slots, cost


def optimal(batch: pd.DataFrame, switch_penalty: float = 0.0, forbidden: bool = False) -> pd.DataFrame:
    """(row, slot, cost): the cheapest matching; pairs without a cost count a little more than the dearest, and are dropped, or with `forbidden` given at an infinite cost."""
    rows, slots, cost = _dense(batch)
    known = np.isfinite(cost)
    full = np.where(known, cost, cost[known].max() + max(1.0, 100 * switch_penalty) if known.any() else 1e9)
    r, c = least_cost(full)
    keep = known[r, c] | forbidden
    return pd.DataFrame({"row": rows[r[keep]], "slot": slots[c[keep]], "cost": cost[r[keep], c[keep]]})


def greedy(batch: pd.DataFrame) -> pd.DataFrame:
    """(row, slot, cost): rows by decreasing margin of their best over their second best, then best cost, then row; each takes its cheapest free slot."""
    rows, slots, cost = _dense(batch)
    order = []
    for i in range(len(rows)):
        own = np.sort(cost[i][np.isfinite(cost[i])])
        if len(own):
            order.append((-(own[1] - own[0] if len(own) > 1 else 1e6), own[0], i))
    free, out = np.ones(len(slots), dtype=bool), []
    for _, _, i in sorted(order):
        left = np.where(free, cost[i], np.inf)
        j = int(np.argmin(left))
        if np.isfinite(left[j]):
            free[j] = False
            out.append((rows[i], slots[j], cost[i, j]))
    return pd.DataFrame(out, columns=["row", "slot", "cost"])


METHODS = {"optimal": optimal, "penalised": partial(optimal, forbidden=True), "greedy": greedy}


def assigned(edges: DataFrame, method: str, last_resort: bool = False) -> DataFrame:
    """(batch, row, slot, cost, fallback) from edges (batch, row, slot, cost; cost null: not allowed).

    Rows that the matching leaves out take their own cheapest slot, which others may have too. A row without an allowed
    slot stays unmatched (slot and cost null), or with last_resort takes its lowest one at a cost of 1e9. A batch is what one
    evaluation point decides, so it is small and its size doesn't follow the number of sessions.
    """
    solve = METHODS[method]

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = solve(batch)
        out.insert(0, "batch", batch["batch"].iloc[0])
        return out

    kinds = dict(edges.dtypes)
    kept = edges.select("batch", "row", "slot", F.col("cost").cast("double").alias("cost"))
    matched = kept.groupBy("batch").applyInPandas(run, f"batch {kinds['batch']}, row {kinds['row']}, slot {kinds['slot']}, cost double")
    own = kept.groupBy("batch", "row").agg(F.min(F.when(F.col("cost").isNotNull(), F.struct("cost", "slot"))).alias("m"), F.min("slot").alias("any"))
    slot, cost = (F.coalesce("m.slot", "any"), F.coalesce("m.cost", F.lit(1e9))) if last_resort else (F.col("m.slot"), F.col("m.cost"))
    alone = own.select("batch", "row", slot.alias("own_slot"), cost.alias("own_cost"))
    joined = alone.join(matched, ["batch", "row"], "left")
    return joined.select("batch", "row", F.coalesce("slot", "own_slot").alias("slot"), F.coalesce("cost", "own_cost").alias("cost"), F.col("slot").isNull().alias("fallback"))

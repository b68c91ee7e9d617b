"""Column expressions over scalars, arrays and text; all stay inside Spark's own operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equals(conditions: dict) -> Column:
    """All columns equal their value; a value None means null."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in conditions.items()), F.lit(True))


def close(column: str, value: float, absolute: float = 1e-9, relative: float = 1e-6) -> Column:
    """Finite and within the larger of the tolerances."""
    x = F.col(column)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x - value) <= max(absolute, abs(value) * relative))


def z_scores(v: str) -> Column:
    # mean and deviation are taken once for each array: they are passed on as the items of arrays of one
    mean = f"aggregate({v}, 0D, (a, x) -> a + x) / nullif(size({v}), 0)"
    std = f"sqrt(aggregate({v}, 0D, (a, x) -> a + (x - m) * (x - m)) / nullif(size({v}), 0))"
    return F.expr(f"flatten(transform(array({mean}), m -> flatten(transform(array({std}), d -> transform({v}, x -> if(d < 1e-6, 0D, (x - m) / d))))))")


def mean_of(v: str) -> Column:
    return F.expr(f"aggregate({v}, 0D, (a, x) -> a + x) / size({v})")


def median_of(v: str) -> str:
    """SQL of the median of an array expression."""
    s = f"array_sort({v})"
    return f"(get({s}, (size({v}) - 1) div 2) + get({s}, size({v}) div 2)) / 2"


def segment_medians(v: str, segment: int, steps: int) -> Column:
    """Medians of consecutive segments; one that begins past the end has the median of the whole array."""
    part = f"slice({v}, k * {segment} + 1, {segment})"
    return F.expr(f"transform(sequence(0, {steps - 1}), k -> if(k * {segment} < size({v}), {median_of(part)}, {median_of(v)}))")


def mean_gap(a: str, b: str) -> Column:
    return F.abs(mean_of(a) - mean_of(b))


def l1(a: str, b: str) -> Column:
    """Sum of absolute differences after the first element, over the places that both have."""
    return F.expr(f"aggregate(filter(zip_with(slice({a}, 2, greatest(size({a}) - 1, 0)), slice({b}, 2, greatest(size({b}) - 1, 0)), (x, y) -> abs(x - y)), d -> d is not null), 0D, (s, d) -> s + d)")


def mean_abs(a: str, b: str) -> Column:
    """Mean absolute difference of two arrays of one length."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> abs(x - y)), 0D, (s, d) -> s + d) / size({a})")


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation of two arrays; 0 where a deviation is 1e-8 or less, clipped to -1..1."""
    ma, mb = mean_of(a), mean_of(b)
    dev = lambda v, m: F.sqrt(F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v))
    sa, sb = dev(a, ma), dev(b, mb)
    both = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: (x - ma) * (y - mb)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when((F.size(a) > 1) & (sa > 1e-8) & (sb > 1e-8), F.least(F.greatest(both / (sa * sb), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def proxy_distance(p: str, q: str) -> Column:
    """Distance of two patterns: z-scores, levels, steps and means, weighted 1, 0.05, 0.02, 0.01."""
    steps = lambda v: F.expr(f"transform(sequence(1, size({v}) - 1), k -> {v}[k] - {v}[k - 1])")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    shape = F.sqrt(total(F.zip_with(z_scores(p), z_scores(q), lambda x, y: (x - y) * (x - y))))
    level = total(F.zip_with(F.col(p), F.col(q), lambda x, y: F.abs(x - y))) / F.size(p)
    step = total(F.zip_with(steps(p), steps(q), lambda x, y: F.abs(x - y))) / (F.size(p) - 1)
    return shape + 0.05 * level + 0.02 * step + 0.01 * mean_gap(p, q)


def to_pattern_text(v: str) -> Column:
    """12|7|0 of an array of whole numbers."""
    return F.expr(f"array_join(transform({v}, x -> cast(cast(x as bigint) as string)), '|')")


def from_pattern_text(v: str) -> Column:
    """The whole numbers of 12|7|0; blanks between bars are skipped."""
    return F.expr(f"transform(filter(split({v}, '[|]'), x -> trim(x) <> ''), x -> cast(trim(x) as bigint))")


def half_up(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, exact, rounded half up."""
    return F.round(part.cast("decimal(18,0)") / whole.cast("decimal(18,0)"), digits)


def finite(column: str) -> Column:
    """The value as a double, null unless it is a finite number."""
    x = F.expr(f"try_cast({column} as double)")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def label_of(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that x doesn't exceed; the last one above all."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(x <= edge, label).otherwise(out)
    return out


def canonical_hash(df: DataFrame, keys: list[str], columns: list[str]) -> Column:
    """sha256 of the group's rows as text, in the order of the columns; an aggregate."""
    row = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ";").cast("binary"), 256)

"""The matcher by time alone against every matching; its costs tie, so the total is held, not the pairs."""

from itertools import permutations

from tidemark.plans import catalogue, matching_queries

SF = "/root/testdata/sf0.001"


def test_time_only_is_a_cheapest_matching(spark):
    batches = {}
    for r in matching_queries._full(matching_queries._pairs(spark, SF)).select("batch", "row", "slot").collect():
        rows, slots = batches.setdefault(r.batch, (set(), set()))
        rows.add(r.row)
        slots.add(r.slot)
    found = {}
    for r in catalogue.queries()["m6_time_only"](spark, SF).collect():
        assert not r.fallback and abs(r.cost - abs(r.row - r.slot)) < 1e-4
        found.setdefault(r.batch, []).append((r.row, r.slot))
    assert found.keys() == batches.keys() and found
    for batch, (rows, slots) in batches.items():
        got = found[batch]
        assert {a for a, _ in got} == rows and {b for _, b in got} == slots and len(got) == 5
        least = min(sum(abs(a - b) for a, b in zip(sorted(rows), p, strict=True)) for p in permutations(slots))
        assert sum(abs(a - b) for a, b in got) == least

import random

import pytest

from symweave.operators import references

EDGES = "edge_id long, project string, source_stable_id string, target_stable_id string, loaded_at timestamp_ntz, begins string, ref string"
NODES = "project string, stable_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, day string, ends int"


def brute(edges, nodes):
    found = []
    for e, p, s, t, at, *_ in edges:
        for side, ref in (("source", s), ("target", t)):
            if ref is not None and not any(n[0] == p and n[1] == ref and n[2] is not None and at is not None and n[2] <= at and (n[3] is None or n[3] > at) and p is not None for n in nodes):
                found.append((e, side))
    return sorted(found)


def run(spark, edges, nodes, **more):
    df = references.orphan_references(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), **more)
    return sorted((r.edge_id, r.side) for r in df.collect())


def test_boundaries_nulls_and_other_projects(spark, at):
    nodes = [("p", "a", at(1), at(5), "x", 1), ("p", "a", at(1), at(5), "x", 1), ("p", "b", at(0), None, "x", 1), ("q", "c", at(0), None, "x", 1), (None, "d", at(0), None, "x", 1), ("p", "e", None, None, "x", 1), ("p", "f", at(3), at(3), "x", 1)]
    edges = [(i, "p", "a", "b", at(h), "c", "d") for i, h in enumerate((0, 1, 4.999, 5, 30))]
    edges += [(10, "p", "c", None, at(2), "c", "d"), (11, None, "d", "b", at(2), "c", "d"), (12, "p", None, None, at(2), "c", "d"), (13, "p", "b", "e", None, "c", "d"), (14, "p", "f", "b", at(3), "c", "d"), (14, "p", "f", "b", at(3), "c", "d")]
    assert run(spark, edges, nodes) == brute(edges, nodes)


@pytest.mark.parametrize("share", [0.001, 0.1])
def test_against_brute_force_with_hot_keys(spark, at, share):
    rng = random.Random(7)
    keys = ["hot"] * 20 + [f"k{i}" for i in range(30)]
    nodes = [("p", rng.choice(keys), at(h := rng.randrange(200)), at(h + rng.randrange(60)) if rng.random() < 0.7 else None, "x", 1) for _ in range(60)]
    edges = [(i, "p", rng.choice(keys), rng.choice(keys), at(rng.randrange(300) + rng.random()), "x", "y") for i in range(400)]
    assert run(spark, edges, nodes, heavy_share=share) == brute(edges, nodes)


def test_empty_tables_and_counts(spark, at):
    assert run(spark, [], []) == []
    edges = [(1, "p", "a", "b", at(2), "x", "y"), (2, "p", "a", None, at(30), "x", "y")]
    assert run(spark, edges, []) == [(1, "source"), (1, "target"), (2, "source")]
    counts = references.orphan_counts(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("p", "b", at(0), None, "x", 1)], NODES)).collect()
    assert {(r.side, str(r.day), r.n_references, r.n_orphans, r.n_missing_keys) for r in counts} == {("source", "2026-03-01", 1, 1, 1), ("target", "2026-03-01", 1, 0, 0), ("source", "2026-03-02", 1, 1, 1)}


def test_hot_keys_are_broadcast_and_many_versions_of_a_day(spark, at):
    """A valid and a missing key of a quarter of all references each, and a key with versions every other minute."""
    nodes = [("p", "valid", at(0), None, "x", 1)] + [("p", "busy", at(i / 30), at(i / 30 + 1 / 60), "x", 1) for i in range(900)]
    refs = ["valid", "missing", "busy", *(f"k{i}" for i in range(90))]
    edges = [(i, "p", refs[i % 2] if i % 4 < 2 else refs[2 + i % 91], None, at(i / 50), "x", "y") for i in range(1500)]
    df = references.orphan_references(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), heavy_share=0.1)
    assert sorted((r.edge_id, r.side) for r in df.collect()) == brute(edges, nodes)
    counts = references.orphan_counts(spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), heavy_share=0.1).collect()
    assert sum(r.n_orphans for r in counts) == len(brute(edges, nodes)) and sum(r.n_references for r in counts) == 1500

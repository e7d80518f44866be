import random

import pytest

from symweave.operators import hierarchy, lists
from symweave.operators.lists import rank_lists

EDGES = "project string, source_stable_id string, target_stable_id string, kind string, id string, root string"


def rows(pairs, project="p", kind="DECLARES"):
    return [(project, a, b, kind, "x", "y") for a, b in pairs]


def cyclic(spark, edges, **more):
    return sorted(r.stable_id for r in hierarchy.cyclic_nodes(spark.createDataFrame(edges, EDGES), **more).collect())


def brute_cyclic(pairs):
    nodes, bad = {n for p in pairs for n in p}, set()
    for n in nodes:
        seen, front = set(), {a for a, b in pairs if b == n}
        while front:
            seen |= front
            front = {a for a, b in pairs if b in front} - seen
        bad |= {n} if n in seen else set()
    while True:
        more = {b for a, b in pairs if a in bad} - bad
        if not more:
            return sorted(bad)
        bad |= more


def test_cycles_and_what_lies_below(spark):
    pairs = [("r", "a"), ("a", "b"), ("s", "s"), ("s", "t"), ("t", "u"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "w"), ("w", "v"), *((f"c{i}", f"c{i + 1}") for i in range(9))]
    edges = rows(pairs) + rows(pairs[:4]) + [("p", "b", "r", "CALLS", "x", "y"), ("p", None, "a", "DECLARES", "x", "y"), ("p", "a", None, "DECLARES", "x", "y"), (None, "m", "m", "DECLARES", "x", "y")]
    assert cyclic(spark, edges) == ["s", "t", "u", "v", "w", "x", "y", "z"]


@pytest.mark.parametrize("seed", [1, 2])
def test_several_parents_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(14)})
    assert cyclic(spark, rows(pairs)) == brute_cyclic(pairs)


def test_places_of_a_forest(spark):
    rng = random.Random(3)
    parent = {f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 40)}
    edges = rows([(p, c) for c, p in parent.items()], kind=" declares ") + rows([("n0", "n9")], project="q")
    found = hierarchy.hierarchies(spark.createDataFrame(edges, EDGES))
    got = {r.stable_id: r for r in found.collect() if r.project == "p"}
    for n in ["n0", *parent]:
        path = [n]
        while path[0] in parent:
            path.insert(0, parent[path[0]])
        assert (got[n].path, got[n].depth, got[n].root) == (path, len(path) - 1, "n0")
    below = {n: {m for m in got if got[n].entry < got[m].entry < got[n].exit} for n in got}
    assert all(below[n] == {m for m in got if n in got[m].path and n != m} and len(below[n]) == got[n].n_descendants for n in got)
    assert sorted(v for r in got.values() for v in (r.entry, r.exit)) == list(range(80))
    pairs = hierarchy.descendants(found).where("project = 'p'").collect()
    assert {(r.ancestor, r.descendant) for r in pairs} == {(n, m) for n in below for m in below[n]}


def test_empty(spark):
    assert cyclic(spark, []) == [] and hierarchy.hierarchies(spark.createDataFrame([], EDGES)).collect() == []


def test_list_ranking(spark):
    elements = [(i, i - 1 if i % 10 else None, 2) for i in range(30)] + [(100, 101, 1), (101, 100, 1), (102, 101, 1)]
    ranked = {r.id: (r.head, r.w) for r in rank_lists(spark.createDataFrame(elements, "id long, previous long, w long"), ["w"]).collect()}
    assert all(ranked[i] == (i - i % 10, 2 * (i % 10 + 1)) for i in range(30))
    assert [ranked[i][0] for i in (100, 101, 102)] == [None] * 3


def rounds(monkeypatch):
    """Counts the lineages cut."""
    cuts = []
    for module in (hierarchy, lists):
        for name in {"cut", "cut_counted"} & set(vars(module)):
            monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), **k: cuts.append(1) or f(*a, **k))
    return cuts


def test_long_chain_below_a_cycle(spark, monkeypatch):
    """What hangs below a cycle takes logarithmic rounds too."""
    cuts = rounds(monkeypatch)
    pairs = [("x", "y"), ("y", "x"), ("x", "n000"), *((f"n{i:03}", f"n{i + 1:03}") for i in range(200)), ("root", "a")]
    assert cyclic(spark, rows(pairs)) == brute_cyclic(pairs)
    assert len(cuts) < 30


def test_high_chain_with_a_node_of_two_parents(spark, monkeypatch):
    """The rounds are logarithmic in the height, also where a node has several parents, and with all nodes in one list."""
    cuts, n = rounds(monkeypatch), 100_000
    chain = spark.range(n).selectExpr("'p' AS project", "concat('n', id) AS source_stable_id", "concat('n', id + 1) AS target_stable_id", "'DECLARES' AS kind")
    more = spark.createDataFrame(rows([("n7", "n50000"), ("n99999", "n60000")]), EDGES).select(chain.columns)
    assert hierarchy.cyclic_nodes(chain.union(more)).count() == n - 60_000 + 1
    assert len(cuts) < 60


def test_hot_parent(spark):
    """A parent of most nodes, most of them leaves."""
    pairs = [("r", f"c{i:04}") for i in range(3000)] + [(f"c{i:04}", f"d{i}") for i in range(0, 3000, 10)] + [("s", "s"), *(("s", f"t{i}") for i in range(50))]
    found = hierarchy.hierarchies(spark.createDataFrame(rows(pairs), EDGES)).collect()
    assert len(found) == 3301 and {r.n_descendants for r in found if r.stable_id == "r"} == {3300}
    assert len(cyclic(spark, rows(pairs))) == 51

"""Cycle paths and inheritance chains against plain walks."""

import random

import pytest

from srcatlas.operators import graph, validation, variables


def reachable(adjacent, node):
    seen, todo = set(), list(adjacent.get(node, ()))
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += adjacent.get(at, ())
    return seen


def plain_cycles(edges):
    """Mutual reachability, then the shortest way from the smallest node back to it."""
    adjacent = {}
    for a, b in edges:
        adjacent.setdefault(a, set()).add(b)
    reach = {n: reachable(adjacent, n) for e in edges for n in e}
    out = []
    for least in sorted(n for n in reach if n in reach[n]):
        inside = {n for n in reach[least] if least in reach[n]}
        if min(inside) != least:
            continue
        ways = [(least,)]
        while not (done := [w for w in ways if least in adjacent.get(w[-1], ())]):
            further = sorted((*w, n) for w in ways for n in adjacent.get(w[-1], ()) if n in inside and n not in w)
            best = {}
            for w in further:
                best.setdefault(w[-1], w)
            ways = list(best.values())
        out.append((least, len(min(done)), [*min(done), least]))
    return out


def found(spark, edges):
    return sorted(tuple(r) for r in graph.cycle_paths(spark.createDataFrame(edges, "src string, dst string")).collect())


@pytest.mark.parametrize("seed", [2, 7])
def test_cycle_paths_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    edges = [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}") for _ in range(22)]
    assert found(spark, edges) == plain_cycles(edges)


def test_a_long_ring_is_one_row(spark):
    """Rounds follow the logarithm of a ring's length, also where names rise all the way round."""
    ring = [(f"n{i:05}", f"n{(i + 1) % 2000:05}") for i in range(2000)]
    assert found(spark, [*ring, ("n00007", "end"), ("x", "n00100")]) == [("n00000", 2000, [f"n{i:05}" for i in range(2000)] + ["n00000"])]


def test_dense_and_empty_graphs(spark):
    dense = [(f"d{i:02}", f"d{j:02}") for i in range(30) for j in range(30) if i != j]
    assert found(spark, [*dense, ("z", "z"), ("d03", "out")]) == [("d00", 2, ["d00", "d01", "d00"]), ("z", 1, ["z", "z"])]
    assert found(spark, []) == [] and found(spark, [("a", "b"), (None, "a"), ("b", None)]) == []


def test_circular_dependencies(spark):
    frame = spark.createDataFrame([("b", ["c"]), ("c", ["a"]), ("a", ["b"]), ("d", ["a"])], "id string, depends array<string>")
    assert [tuple(r) for r in validation.circular_dependencies(frame).collect()] == [("a", "a -> b -> c -> a")]


def plain_chain(table, root, by_path):
    """A depth-first walk that stops at its first repeat."""
    order, seen = [root], {root}

    def walk(name, way):
        for ref in table.get(name, []):
            if ref in way or (not by_path and ref in seen):
                return True
            if ref not in seen:
                seen.add(ref)
                order.append(ref)
                if walk(ref, (*way, ref)):
                    return True
        return False

    cycle = walk(root, (root,))
    return root, order, len(order) - 1, cycle


@pytest.mark.parametrize("by_path", [True, False])
def test_inheritance_against_a_walk(spark, by_path):
    draw = random.Random(4)
    table = {f"v{i}": [f"v{draw.randrange(16)}" for _ in range(draw.randrange(0, 3))] for i in range(14)}
    table |= {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": [], "x": ["y", "y"], "y": ["unknown"]}
    frame = spark.createDataFrame(list(table.items()), "name string, refs array<string>")
    got = {r["name"]: tuple(r) for r in variables.inheritance(frame, by_path=by_path).collect()}
    assert got == {n: plain_chain(table, n, by_path) for n in table}
    asked = variables.inheritance(frame, frame.where("name = 'a'"), by_path).collect()
    assert [tuple(r) for r in asked] == [plain_chain(table, "a", by_path)]

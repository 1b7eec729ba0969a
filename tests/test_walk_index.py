"""The index of read paths in arrays gives the continuations, middles and pairs that plain loops find."""

from collections import defaultdict

import numpy as np

from strandweave.operators import search as SE


def made(spark, paths):
    names = sorted({n for p, _ in paths for n, _ in p})
    segments = spark.createDataFrame([(n, 100, 10.0) for n in names], "name string, len int, cov double")
    links = spark.createDataFrame([(names[0], True, names[1], False, 5)], "v1 string, e1 boolean, v2 string, e2 boolean, overlap int")
    rows = [([{"n": n, "e": e} for n, e in p], c) for p, c in paths]
    return SE.world(segments, links, spark.createDataFrame(rows, "path array<struct<n:string,e:boolean>>, n long").repartition(3))


def some(rng, contigs=4, many=60, longest=7):
    out = {}
    for _ in range(many):
        p = tuple((f"c{rng.integers(contigs)}", bool(rng.integers(2))) for _ in range(rng.integers(1, longest)))
        out[min(p, tuple(SE.reverse(list(p))))] = int(rng.integers(1, 9))
    return list(out.items())


def plain(paths, path, longest, length, decay, differ):
    """As the loops over tuples did it: continuations with their weights, and how often the path stands in the middle."""
    starts, middles = defaultdict(list), defaultdict(list)
    for p, n in paths:
        for q in (p, tuple(SE.reverse(list(p)))):
            for k in range(1, len(q)):
                starts[q[:k]].append((q, n))
            for a in range(1, len(q) - 1):
                for b in range(a + 1, len(q)):
                    middles[q[a:b]].append(q)
    got, bases = {}, 0
    for k in range(1, len(path) + 1):
        bases += length if k > 2 else 0
        if bases >= longest:
            break
        found = starts.get(tuple(path[-k:]), [])
        total = sum(n**differ for _, n in found)
        for q, n in found:
            got[q[k:]] = max(got.get(q[k:], 0), n**differ / total * decay**k)
    return got, middles.get(tuple(path), [])


def test_numbered_paths_are_the_paths(spark):
    paths = some(np.random.default_rng(3))
    w = made(spark, paths)
    assert [(tuple(w.strand(i, True)), int(w.n[i])) for i in range(len(w))] == sorted(paths, key=lambda x: (-x[1], x[0]))
    assert w.flat.dtype == np.int32  # numbers, not an object for each step
    assert w.pairs() == {SE.both_ways(a, b) for p, _ in paths for a, b in zip(p, p[1:], strict=False)}


def test_continuations_and_middles_are_those_of_plain_loops(spark, monkeypatch):
    seen = []
    real = SE.options
    monkeypatch.setattr(SE, "options", lambda *a: seen.append(real(*a)) or seen[-1])
    middle = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        paths = [*some(rng), ((("x", True), ("y", True), ("y", False), ("z", True)), 3)]
        w = made(spark, paths).build()
        held = w.index
        for s in (SE.Settings(), SE.Settings(longest_alignment=250, differ=0.5, decay=3.0)):
            walks = [list(p)[-k:] for p, _ in some(rng, many=30) for k in (1, 3, 6)] + [[("y", True)], [("y", True), ("y", False)], [("z", True)]]
            for path in walks:
                seen.clear()
                more = SE.extend(w, s, np.random.default_rng(1), path)
                want, inside = plain(paths, path, s.longest_alignment, 100, s.decay, s.differ)
                if not want:
                    assert not seen
                    assert len(w.holding(w.codes(path))) == len(inside)
                    middle += bool(inside)
                    assert not inside or any(tuple(path) + tuple(more) == q[a:] for q in inside for a in range(1, len(q)))
                    continue
                places, weights = seen[0]
                rests = [tuple(w.steps(held["flat"][p : held["off"][np.searchsorted(held["off"], p, "right")]])) for p in places]
                assert len(set(rests)) == len(rests) and set(rests) == set(want)
                scale = weights[0] / want[rests[0]]
                assert np.allclose(weights, [want[r] * scale for r in rests], rtol=1e-12)
                assert tuple(more) in want
    assert middle


def test_long_walks_keep_the_order_of_weights(spark):
    """Powers of the walk's length once ran out of numbers after some 230 steps, and all continuations came out alike."""
    w = made(spark, [((("a", True), ("b", True)), 999), ((("a", True), ("c", True)), 1)]).build()
    path = [("a", True)] * 400
    places, weights = SE.options(w, SE.Settings(), [(1, *w.starting(w.codes(path[-1:])))])
    assert sorted(weights.tolist()) == [0.001, 0.999]

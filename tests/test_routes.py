"""Paths of a frame and their orphans against a plain version and on known graphs."""

import random
import time as clock

import pytest

from wavefold.operators import routes

EDGES = "time int, src long, dst long, arc double, weight double, lon1 double, lat1 double, lon2 double, lat2 double"


def sep(a, b):
    return min(abs(a - b) % 360, 360 - abs(a - b) % 360)


def bins(start, length):
    return {round((start + k) % 360) % 360 for k in range(int(length) + 1)}


def frame(edges, place, gate=15.0):
    full = {(a, b): (w, sep(place[a][0], place[b][0])) for (a, b), w in edges.items()}
    return routes.Frame(full, place, {a: [round((place[a][0] + k) % 360) % 360 for k in range(360)] for a, _ in edges}, gate)


def meets(p, q, place, gate):
    arc = lambda p: sum(sep(place[a][0], place[b][0]) for a, b in zip(p, p[1:], strict=False))
    lat = lambda p: (min(place[n][1] for n in p), max(place[n][1] for n in p))
    (l1, h1), (l2, h2) = lat(p), lat(q)
    return max(l1, l2) - min(h1, h2) <= gate and bool(bins(place[p[0]][0], arc(p)) & bins(place[q[0]][0], arc(q)))


def parts(lons, weights):
    """Begin and end of the parts of a path none of which goes round."""
    arc = sum(sep(a, b) for a, b in zip(lons, lons[1:], strict=False))
    if len(lons) < 3 or arc < 360:
        return [(0, len(lons))] if len(lons) > 1 else []
    cut = weights.index(min(weights)) + 1
    return parts(lons[:cut], weights[: cut - 1]) + [(a + cut, b + cut) for a, b in parts(lons[cut:], weights[cut:])]


def plain_paths(edges, place, gate):
    """All simple east paths by depth first search, split where they go round; then the greedy choice, one at a time."""
    out, found = {}, []

    def go(path):
        d = place[path[0]][0] - place[path[-1]][0]
        if len(path) > 1 and (-d if abs(d) > 180 else d) <= 0:
            found.append(list(path))
        for a, b in edges:
            if a == path[-1] and b not in path:
                go([*path, b])

    for n in place:
        go([n])
    for p in found:
        w = [edges[e] for e in zip(p, p[1:], strict=False)]
        for a, b in parts([place[n][0] for n in p], w):
            out[tuple(p[a:b])] = sum(w[a : b - 1])
    kept, used = [], set()
    for p, _ in sorted(out.items(), key=lambda x: (-x[1], x[0])):
        if used.isdisjoint(p) and not any(meets(p, q, place, gate) for q in kept):
            kept.append(p)
            used.update(p)
    return kept


def random_graph(rng, n, reach, density, step):
    place = {i: (rng.randrange(0, int(360 / step)) * step, float(rng.randrange(20, 80, 5))) for i in range(n)}
    east = lambda a, b: (place[b][0] - place[a][0] + 180) % 360 - 180
    return place, {(a, b): rng.randrange(1, 24) / 8 for a in place for b in place if 0 < east(a, b) < reach and rng.random() < density}


@pytest.mark.parametrize("seed", range(12))
def test_paths_are_those_of_the_plain_version(seed):
    """Short and long edges, with and without ways round the globe, many equal weights, halves of a degree."""
    rng = random.Random(seed)
    round_ = 0
    for _ in range(25):
        n, reach, density = rng.choice([(11, 90, 0.3), (9, 179, 0.35), (10, 150, 0.3), (12, 120, 0.25)])
        place, edges = random_graph(rng, n, reach, density, rng.choice([2.5, 5.0, 30.0, 7.3]))
        if not edges:
            continue
        f = frame(edges, place)
        round_ += f.turns()
        assert f.packets() == plain_paths(edges, place, 15.0)
    assert round_ > 3


def test_rings_of_several_turns():
    """Spirals whose ways go round more than once."""
    rng = random.Random(1)
    for n, step in ((13, 30.0), (14, 55.0), (15, 100.0), (16, 130.0)):
        place = {i: (i * step % 360, 20.0 + 3 * i) for i in range(n)}
        for _ in range(6):
            edges = {(i, i + 1): rng.randrange(1, 12) / 4 for i in range(n - 1)} | {(i, i + 2): rng.randrange(1, 12) / 4 for i in range(n - 2) if 2 * step < 180}
            for gate in (0.0, 15.0):
                assert frame(edges, place, gate).packets() == plain_paths(edges, place, gate)


def test_frames_of_very_many_paths():
    """Two bands of a lattice with 3^31 paths from each corner, of equal and of other weights, then one short edge between."""
    for even in (True, False):
        weigh = lambda a, b: 1.0 if even else 1.0 + (a * 7 + b * 3) % 11 / 16  # noqa: B023, E731
        at = lambda c, r: 10 * c + r
        place = {at(c, r): (5.0 * c, (20.0 if r < 3 else 50.0) + 2 * r) for c in range(32) for r in range(6)}
        edges = {(at(c, r), at(c + 1, s)): weigh(at(c, r), at(c + 1, s)) for c in range(31) for r in range(6) for s in range(6) if r // 3 == s // 3}
        begin = clock.perf_counter()
        found = frame(edges, place).packets()
        assert clock.perf_counter() - begin < 30 and [len(p) for p in found] == [32, 32]
        assert not even or found == [tuple(at(c, r) for c in range(32)) for r in (0, 3)]


def node_places(*lons, lats=None):
    return {i: (float(x), 50.0 if lats is None else lats[i]) for i, x in enumerate(lons)}


@pytest.mark.parametrize(
    ("edges", "place", "paths", "want"),
    [
        # beyond an end; west of a beginning; one after the other
        ({(0, 1): 5, (1, 2): 4}, node_places(10, 40, 70), [(0, 1)], [[0, 1, 2]]),
        ({(1, 2): 5, (0, 1): 3}, node_places(10, 30, 60), [(1, 2)], [[0, 1, 2]]),
        ({(0, 1): 1, (1, 2): 1, (2, 3): 5, (4, 5): 1}, node_places(0, 10, 20, 30, 50, 60), [(2, 3), (4, 5)], [[0, 1, 2, 3], [4, 5]]),
        # weaker than the arm that is there
        ({(0, 1): 5, (1, 2): 5, (1, 3): 0.5}, node_places(10, 40, 80, 55), [(0, 1, 2)], [[0, 1, 2]]),
        # stronger: the arm goes, and its node loses against what came
        ({(0, 1): 5, (1, 2): 2, (1, 3): 8}, node_places(10, 40, 70, 55), [(0, 1, 2)], [[0, 1, 3]]),
        # outside the gate, however strong the edge
        ({(0, 1): 5, (1, 2): 9}, node_places(10, 40, 60, lats=[50.0, 50.0, 25.0]), [(0, 1)], [[0, 1]]),
        # would meet another path; is not tried again at its other neighbour
        ({(0, 1): 5, (2, 3): 5, (1, 4): 9}, node_places(10, 40, 70, 100, 80), [(0, 1), (2, 3)], [[0, 1], [2, 3]]),
        ({(0, 1): 5, (2, 3): 5, (1, 4): 9, (3, 4): 1}, node_places(10, 40, 70, 100, 120), [(0, 1), (2, 3)], [[0, 1], [2, 3]]),
        # the heaviest neighbour within the gate counts
        ({(0, 1): 5, (1, 3): 1, (2, 3): 9}, node_places(10, 40, 30, 60, lats=[50.0, 50.0, 20.0, 50.0]), [(0, 1)], [[0, 1, 3]]),
    ],
)
def test_orphans(edges, place, paths, want):
    assert frame({e: float(w) for e, w in edges.items()}, place).adopt(paths) == want


def test_packets_of_several_frames(spark):
    rng = random.Random(5)
    rows, want = [], []
    for time in range(4):
        place, edges = random_graph(rng, 11, 120, 0.3, 2.5)
        rows += [(time, a, b, sep(place[a][0], place[b][0]), w, *place[a], *place[b]) for (a, b), w in edges.items()]
        linked = {n: place[n] for e in edges for n in e}
        f = frame(edges, linked)
        want += [(time, i + 1, k, n) for i, p in enumerate(f.adopt(plain_paths(edges, linked, 15.0))) for k, n in enumerate(p)]
    got = routes.packets(spark.createDataFrame(rows, EDGES).repartition(3))
    assert sorted(map(tuple, got.collect())) == want
    assert routes.packets(spark.createDataFrame([], EDGES)).collect() == []

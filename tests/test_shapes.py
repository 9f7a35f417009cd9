"""Unions, shared areas and concave hulls: closed forms, a fine raster, and inclusion and exclusion."""

import itertools
import math
import random
import struct

import numpy as np
import pytest

from wavefold.operators import frames, shapes


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


L = [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6)]
U = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]


def size(polygons):
    return sum(frames.area(p[0]) - sum(map(frames.area, p[1:])) for p in polygons)


def holds(ring, x, y):
    return sum((y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def test_unions_in_closed_form():
    assert [len(p) for p in shapes.union([box(0, 0, 4, 4), box(2, 2, 4, 4)])] == [1]
    assert size(shapes.union([box(0, 0, 4, 4), box(2, 2, 4, 4)])) == 28
    # side by side, one inside the other, the same twice, apart, at a corner
    assert shapes.union([box(0, 0, 2, 2), box(2, 0, 2, 2)])[0][0] and size(shapes.union([box(0, 0, 2, 2), box(2, 0, 2, 2)])) == 8
    assert len(shapes.union([box(0, 0, 2, 2), box(2, 0, 2, 2)])) == 1
    assert size(shapes.union([box(0, 0, 9, 9), box(2, 2, 2, 2)])) == 81
    assert size(shapes.union([box(0, 0, 2, 2)] * 3)) == 4
    assert len(shapes.union([box(0, 0, 2, 2), box(5, 0, 2, 2)])) == len(shapes.union([box(0, 0, 2, 2), box(2, 2, 2, 2)])) == 2
    # a frame of four boxes has a hole, and a box in the hole is a polygon of its own
    frame = [box(0, 0, 9, 2), box(0, 7, 9, 2), box(0, 0, 2, 9), box(7, 0, 2, 9)]
    (ring,) = shapes.union(frame)
    assert len(ring) == 2 and size([ring]) == 81 - 25
    both = shapes.union([*frame, box(4, 4, 1, 1)])
    assert sorted(map(len, both)) == [1, 2] and size(both) == 57
    # a box that fills the hole to its corners only leaves four holes' worth of nothing
    assert size(shapes.union([*frame, [(2, 4.5), (4.5, 2), (7, 4.5), (4.5, 7)]])) == 81 - 25 + 12.5
    assert shapes.union([]) == [] and shapes.union([[(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2)]]) == []
    # clockwise rings are as good
    assert size(shapes.union([box(0, 0, 4, 4)[::-1], box(2, 2, 4, 4)])) == 28


def meets(p, q, r, s):
    c = shapes._cross
    return c(p, q, r) * c(p, q, s) < 0 and c(r, s, p) * c(r, s, q) < 0


@pytest.mark.parametrize("seed", range(12))
def test_union_by_inclusion_and_exclusion(seed):
    """Hulls that lie on one another: the union's area is the alternating sum of what they share, no two edges cross, and
    the rings hold a point if one of the hulls does."""
    rand = random.Random(seed)
    whole = seed % 2
    at = (lambda: (rand.randint(0, 8) * 100.0, rand.randint(0, 8) * 100.0)) if whole else (lambda: (rand.uniform(0, 1e7), rand.uniform(0, 1e7)))
    hulls = [frames.convex_hull([at() for _ in range(rand.randint(3, 9))]) for _ in range(5)]
    hulls = [h for h in hulls if frames.area(h) > 0]
    total = 0.0
    for n in range(1, len(hulls) + 1):
        for part in itertools.combinations(hulls, n):
            shared = part[0]
            for h in part[1:]:
                shared = frames.clip(shared, h) if len(shared) > 2 else []
            total += (-1) ** (n + 1) * (frames.area(shared) if len(shared) > 2 else 0.0)
    found = shapes.union(hulls)
    assert size(found) == pytest.approx(total, rel=1e-6)
    edges = [e for p in found for r in p for e in zip(r, r[1:] + r[:1], strict=True)]
    assert not any(meets(*e, *f) for e, f in itertools.combinations(edges, 2))
    assert all(len(set(r)) == len(r) for p in found for r in p)
    for _ in range(200):
        x, y = rand.uniform(-10, 810) if whole else rand.uniform(0, 1e7), rand.uniform(-10, 810) if whole else rand.uniform(0, 1e7)
        in_ = [holds(p[0], x, y) and not any(holds(h, x, y) for h in p[1:]) for p in found]
        assert sum(in_) == any(holds(h, x, y) for h in hulls)


@pytest.mark.parametrize(("one", "other"), [(L, U), (L, [(x + 1.5, y + 1.25) for x, y in U]), (U, [(6 - x, 6 - y) for x, y in L]), (U, [(x + 6, y) for x, y in U]), (U, [(3 + 3 * math.cos(k), 3 + 3 * math.sin(k)) for k in range(6)])])
def test_iou_against_a_fine_raster(one, other):
    n = 300
    cells = [(-0.5 + (i + 0.5) * 13 / n, -0.5 + (j + 0.5) * 9 / n) for i in range(n) for j in range(n)]
    a, b = ([shapes.union([s]) for s in (one, other)])
    in_ = lambda p, x, y: any(holds(q[0], x, y) and not any(holds(h, x, y) for h in q[1:]) for q in p)
    hits = [(in_(a, *c), in_(b, *c)) for c in cells]
    want = sum(x and y for x, y in hits) / sum(x or y for x, y in hits)
    assert shapes.iou([one], [other]) == pytest.approx(want, abs=0.01)


def test_iou_in_closed_form():
    assert shapes.areas([L], [U]) == (20, 28, 20) and shapes.iou([L], [L[::-1]]) == 1
    assert shapes.iou([U], [[(2, 2), (4, 2), (4, 6), (2, 6)]]) == 0 and shapes.iou([], []) == 0
    assert shapes.is_convex(box(0, 0, 2, 3)) and not shapes.is_convex(L) and not shapes.is_convex(U)
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    assert not shapes.is_convex([(1000 * x, 1000 * y) for x, y in star])


@pytest.mark.parametrize("seed", range(6))
def test_delaunay_circles_are_empty(seed):
    rand = random.Random(seed)
    # every other time on a coarse grid: points on lines and on circles
    points = sorted({(rand.randint(0, 6 if seed % 2 else 10**10), rand.randint(0, 6 if seed % 2 else 10**10)) for _ in range(40)})
    third = shapes.delaunay(points)
    for (a, b), c in third.items():
        assert shapes._cross(a, b, c) > 0 and third[b, c] == a and third[c, a] == b
        assert not any(shapes._in_circle(a, b, c, d) for d in points)
    hull = frames.convex_hull(points)
    assert {p for e in third for p in e} == set(points)
    assert sum(shapes._cross(a, b, c) for (a, b), c in third.items()) / 6 == pytest.approx(frames.area(hull))


def test_concave_hulls():
    block = [(float(i), float(j)) for i in range(13) for j in range(13)]
    ell = [p for p in block if p[0] <= 3 or p[1] <= 3]
    ring, parts = shapes.concave_hull(ell, 0.0)
    assert frames.area(ring) == pytest.approx(12 * 3 + 9 * 3, abs=1.0) and sum(map(frames.area, parts)) == pytest.approx(frames.area(ring))
    assert all(q in ring or holds(ring, q[0] + 1e-7, q[1] + 2e-7) or q[0] in (0, 3, 12) or q[1] in (0, 3, 12) for q in ell)
    assert frames.area(shapes.concave_hull(ell, 1.0)[0]) == frames.area(frames.convex_hull(ell)) == frames.area(frames.convex_hull(shapes.concave_hull(ell, 0.3)[0]))
    rand = random.Random(5)
    cloud = [(rand.gauss(0, 1e6), rand.gauss(0, 1e6)) for _ in range(300)]
    sizes = [frames.area(shapes.concave_hull(cloud, r)[0]) for r in (0.0, 0.1, 0.3, 0.6, 1.0)]
    assert sizes == sorted(sizes) and sizes[-1] == pytest.approx(frames.area(frames.convex_hull(cloud)), rel=1e-6)
    assert len(set(shapes.concave_hull(cloud, 0.0)[0])) == len(shapes.concave_hull(cloud, 0.0)[0])
    assert shapes.concave_hull([(0, 0), (1, 1), (2, 2)]) == ([], []) and shapes.concave_hull([]) == ([], [])


def test_wkb_of_holes():
    frame = [box(0, 0, 9, 2), box(0, 7, 9, 2), box(0, 0, 2, 9), box(7, 0, 2, 9)]
    b = shapes.wkb(shapes.union(frame))
    assert struct.unpack_from("<BII", b) == (1, 3, 2)
    n = struct.unpack_from("<I", b, 9)[0]
    first, last = struct.unpack_from("<dd", b, 13), struct.unpack_from("<dd", b, 13 + 16 * (n - 1))
    assert first == last and struct.unpack_from("<I", b, 13 + 16 * n)[0] >= 5
    assert struct.unpack_from("<BII", shapes.wkb(shapes.union([box(0, 0, 1, 1), box(5, 5, 1, 1)]))) == (1, 6, 2)


def test_packets_of_rings_of_any_length(spark):
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    rows = [(0, 1, ring(box(0, 0, 4, 4))), (0, 1, ring([(4, 0), (8, 0), (4, 4)])), (0, 1, ring(L)), (0, 2, ring(U)), (1, 1, ring(box(0, 0, 1, 1))), (1, 1, ring([(5, 5), (6, 5), (5, 6)]))]
    df = spark.createDataFrame(rows, "time int, rwp_id long, ring array<struct<x:double,y:double>>")
    got = {(r["time"], r["rwp_id"]): (r["area"], r["polygons"], r["holes"]) for r in frames.merged(df).collect()}
    assert got == {(0, 1): (size(shapes.union([box(0, 0, 4, 4), [(4, 0), (8, 0), (4, 4)], L])), 1, 0), (0, 2): (28, 1, 0), (1, 1): (1.5, 2, 0)}


def test_rings_apart_make_no_arrangement(monkeypatch):
    """Convex rings whose boxes do not touch are their own unions; others are arranged with their neighbours only."""
    box = lambda x, y: [(x, y), (x + 2.0, y), (x + 2.0, y + 1.0), (x, y + 1.0)]
    asked = []
    plane = shapes._Plane
    monkeypatch.setattr(shapes, "_Plane", lambda groups: asked.append(len(groups[0])) or plane(groups))
    assert shapes.union([box(0.0, 0.0), box(10.0, 0.0)[::-1]]) == [[box(0.0, 0.0)], [box(10.0, 0.0)]] and not asked
    found = shapes.union([box(0.0, 0.0), box(10.0, 0.0), box(11.0, 0.5), box(30.0, 5.0)])
    assert asked == [2] and len(found) == 3 and found[:2] == [[box(0.0, 0.0)], [box(30.0, 5.0)]]


def test_overlaps_of_many_pairs():
    """Angles, boxes, stars of either direction and rings that cross themselves, all at once: as pair by pair."""
    rng = random.Random(7)

    def star(n):
        x, y, turns = rng.randrange(8), rng.randrange(8), sorted(rng.uniform(0, 6.28) for _ in range(n))
        ring = [(round(x + r * math.cos(a), 2), round(y + r * math.sin(a), 2)) for a in turns for r in [rng.uniform(1, 6)]]
        return ring[:: rng.choice((1, -1))]

    def angle():
        x, y = rng.randrange(20) / 2, rng.randrange(20) / 2
        return [(x + a, y + b) for a, b in ((-5, -5), (5, -5), (5, 0), (0, 0), (0, 5), (-5, 5))]

    def any_ring():
        return rng.choice((lambda: star(rng.randrange(3, 9)), angle, lambda: [(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(1, 7))]))()

    def flat(rings):
        n = np.array([len(r) for r in rings])
        return np.array([p for r in rings for p in r], float), np.cumsum(n) - n, n

    some, left = [(any_ring(), any_ring()) for _ in range(400)], []
    slow = lambda a, b: left.append(1) or shapes.iou([a], [b])
    got = shapes.ious(flat([a for a, _ in some]), flat([b for _, b in some]), slow)
    # the exact way has its points on a grid
    assert got == pytest.approx([shapes.iou([a], [b]) for a, b in some], abs=1e-8) and 0 < len(left) < 300
    angles = [(angle(), angle()) for _ in range(100)]
    got = shapes.ious(flat([a for a, _ in angles]), flat([b for _, b in angles]), None)
    assert got == pytest.approx([shapes.iou([a], [b]) for a, b in angles], abs=1e-12)

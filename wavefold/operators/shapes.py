"""Shapes in the plane: unions, what two shapes share, and concave hulls.

Points are taken to a grid of 2^-10 metres and all else is exact in whole numbers and fractions, so that edges that lie on
one another, points on edges and points on one circle need no tolerance. Each function is for the shapes of one packet, or
for two footprints; Spark brings them together."""

from __future__ import annotations

import heapq
import math
import struct
from fractions import Fraction

import numpy as np

SCALE = 1024
#: More than floats of points of the grid are off by.
_SURE = 1e-3

Point = tuple[float, float]
Ring = list[Point]


def _grid(ring) -> list[tuple[int, int]]:
    """The ring on the grid, without points that repeat the one before."""
    out = []
    for x, y in ring:
        p = round(x * SCALE), round(y * SCALE)
        if not out or out[-1] != p:
            out.append(p)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def _twice(ring) -> int:
    """Twice the signed area: positive if counter-clockwise."""
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))


def _cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _cuts(edges: list) -> list[set]:
    """For each edge the points of the others' that lie on it or cut it."""
    at = np.array([(*a, *b) for a, b in edges], dtype=np.int64).reshape(-1, 4)
    x1, x2 = np.minimum(at[:, 0], at[:, 2]), np.maximum(at[:, 0], at[:, 2])
    y1, y2 = np.minimum(at[:, 1], at[:, 3]), np.maximum(at[:, 1], at[:, 3])
    cuts = [set(e) for e in edges]
    for i, (a, b) in enumerate(edges):
        near = np.nonzero((x1[i + 1 :] <= x2[i]) & (x2[i + 1 :] >= x1[i]) & (y1[i + 1 :] <= y2[i]) & (y2[i + 1 :] >= y1[i]))[0]
        for j in (near + i + 1).tolist():
            c, d = edges[j]
            sc, sd, sa, sb = _cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b)
            for s, p, k, (u, v) in ((sc, c, i, (a, b)), (sd, d, i, (a, b)), (sa, a, j, (c, d)), (sb, b, j, (c, d))):
                if s == 0 and min(u[0], v[0]) <= p[0] <= max(u[0], v[0]) and min(u[1], v[1]) <= p[1] <= max(u[1], v[1]):
                    cuts[k].add(p)
            if (sc < 0 < sd or sd < 0 < sc) and (sa < 0 < sb or sb < 0 < sa):
                t = Fraction(sc, sc - sd)
                p = tuple(n.numerator if n.denominator == 1 else n for n in (c[0] + t * (d[0] - c[0]), c[1] + t * (d[1] - c[1])))
                cuts[i].add(p)
                cuts[j].add(p)
    return cuts


class _Plane:
    """All edges of several groups of rings, cut where they meet: pieces that meet at their ends only, each with how often
    each group has more of its rings' insides on the left than on the right, and how often it has them on either side."""

    def __init__(self, groups: list[list]):
        edges, of = [], []
        for g, rings in enumerate(groups):
            for ring in rings:
                edges += zip(ring, ring[1:] + ring[:1], strict=True)
                of += [g] * len(ring)
        net: dict = {}
        for (a, b), g, cut in zip(edges, of, _cuts(edges) if edges else [], strict=True):
            way = sorted(cut, reverse=a > b)
            for p, q in zip(way, way[1:], strict=False):
                own = net.setdefault((p, q) if p < q else (q, p), [0] * len(groups))
                own[g] += 1 if p < q else -1
        #: (first, last) with first < last, and the groups' net count in that direction
        self.pieces = list(net.items())
        self.sides = self._wind(len(groups))

    def _wind(self, n: int) -> np.ndarray:
        """(pieces, groups, 2): winding numbers to the left and to the right of each piece, from the pieces that a ray from
        its middle meets: upwards, or to the right if the piece is upright."""
        if not self.pieces:
            return np.zeros((0, n, 2), dtype=np.int64)
        straight = np.array([[float(v) for v in (*p, *q)] for (p, q), _ in self.pieces])
        count = np.array([c for _, c in self.pieces], dtype=np.int64)
        # with x and y swapped, and each piece from its lower end
        swapped = straight[:, [1, 0, 3, 2]]
        falls = swapped[:, 0] > swapped[:, 2]
        swapped[falls] = swapped[falls][:, [2, 3, 0, 1]]
        turned = np.where(falls[:, None], -count, count)
        out = np.zeros((len(count), n, 2), dtype=np.int64)
        for i, ((p, q), own) in enumerate(self.pieces):
            upright = p[0] == q[0]
            x, y = ((a + b) * Fraction(1, 2) for a, b in zip(p, q, strict=True))
            if upright:
                x, y = y, x
            (u, v, w, z), counts = (swapped.T, turned) if upright else (straight.T, count)
            fx, fy = float(x), float(y)
            size = _SURE * (np.abs(w - u) + np.abs(z - v) + np.abs(fx - u) + np.abs(fy - v) + 1)
            side = (w - u) * (fy - v) - (z - v) * (fx - u)
            met = (u <= fx + _SURE) & (w >= fx - _SURE) & (side <= size)
            met[i] = False
            sure = met & (u <= fx - _SURE) & (w >= fx + _SURE) & (side < -size)
            beyond = counts[sure].sum(axis=0)
            # what floats leave open
            for j in np.nonzero(met & ~sure)[0].tolist():
                a, b = self.pieces[j][0]
                if upright:
                    a, b = sorted(((a[1], a[0]), (b[1], b[0])))
                if a[0] <= x < b[0] and _cross(a, b, (x, y)) < 0:
                    beyond = beyond + counts[j]
            # a piece to the right has the inside of its ring above it; swapping sides swaps left and right
            out[i] = np.stack([beyond + own, beyond] if upright else [-beyond, -beyond - own], axis=1)
        return out

    def border(self, inside) -> list[tuple]:
        """Pieces with what is ``inside`` (of winding numbers by group) on their left and nothing of it on their right."""
        out = []
        for ((p, q), _), side in zip(self.pieces, self.sides, strict=True):
            left, right = inside(side[:, 0]), inside(side[:, 1])
            if left != right:
                out.append((p, q) if left else (q, p))
        return out


def _rings(border: list[tuple]) -> list[list]:
    """Directed edges joined to rings, each of which passes no point twice."""
    go: dict = {}
    for p, q in sorted(border):
        go.setdefault(p, []).append(q)
    out = []
    for start in sorted(go):
        while go[start]:
            way, before, at = [start], start, go[start].pop()
            while at != start:
                if at in way:
                    # a ring within the way
                    k = way.index(at)
                    out.append(way[k:])
                    way = way[:k]
                way.append(at)
                onward = min(go[at], key=lambda q: _bend(before, at, q)) if len(go[at]) > 1 else go[at][0]  # noqa: B023
                go[at].remove(onward)
                before, at = at, onward
            out.append(way)
    return out


def _bend(before, at, q) -> tuple:
    """Orders ways on from ``at``: those that turn most to the left first."""
    (bx, by), (dx, dy) = (before[0] - at[0], before[1] - at[1]), (q[0] - at[0], q[1] - at[1])
    side = bx * dy - by * dx
    return (1, 0) if side == 0 else (0 if side < 0 else 2, Fraction(bx * dx + by * dy) / Fraction(side))


def _holds(ring: list, x, y) -> bool:
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + Fraction(x2 - x1) * Fraction(y - y1) / Fraction(y2 - y1):
            inside = not inside
    return inside


def _turned(rings: list[Ring]) -> list[list]:
    """On the grid, counter-clockwise, without those that have no area."""
    own = [(r, _twice(r)) for r in map(_grid, rings) if len(r) > 2]
    return [r if a > 0 else r[::-1] for r, a in own if a]


def _metres(ring) -> Ring:
    return [(float(x) / SCALE, float(y) / SCALE) for x, y in ring]


def _apart(rings: list[list]) -> list[list[list]]:
    """The rings in groups whose boxes do not touch one another's."""
    groups: list[tuple] = []
    for r in rings:
        xs, ys = [x for x, _ in r], [y for _, y in r]
        box, own, rest, grown = (min(xs), min(ys), max(xs), max(ys)), [r], groups, True
        while grown:
            grown, groups, rest = False, rest, []
            for b, some in groups:
                if b[0] <= box[2] and box[0] <= b[2] and b[1] <= box[3] and box[1] <= b[3]:
                    box, own, grown = (min(b[0], box[0]), min(b[1], box[1]), max(b[2], box[2]), max(b[3], box[3])), some + own, True
                else:
                    rest.append((b, some))
        groups = [*rest, (box, own)]
    return [own for _, own in groups]


def union(rings: list[Ring]) -> list[list[Ring]]:
    """What any of the rings holds, as polygons that share points at most: each its outer ring (counter-clockwise) and its
    holes (clockwise). Rings without area add nothing."""
    found = []
    for own in _apart(_turned(rings)):
        # a convex ring by itself is its own union, from its first point on
        if len(own) == 1 and is_convex(own[0]):
            k = own[0].index(min(own[0]))
            found.append(own[0][k:] + own[0][:k])
        else:
            found += _rings(_Plane([own]).border(lambda w: w[0] != 0))
    found.sort(key=min)
    outer = sorted((r for r in found if _twice(r) > 0), key=_twice)
    holes: list[list] = [[] for _ in outer]
    for r in (r for r in found if _twice(r) < 0):
        x, y = ((a + b) * Fraction(1, 2) for a, b in zip(r[0], r[1], strict=True))
        # the smallest that is round it
        holes[next(i for i, o in enumerate(outer) if _holds(o, x, y))].append(r)
    return [[_metres(o), *map(_metres, h)] for o, h in zip(outer, holes, strict=True)]


def areas(one: list[Ring], other: list[Ring]) -> tuple[float, float, float]:
    """The areas of two shapes, each what its rings hold, and of what they share, in whatever unit: the grid is fitted to the
    largest coordinate."""
    most = max((abs(v) for r in (*one, *other) for p in r for v in p), default=0.0)
    k = 2.0 ** (34 - math.frexp(most)[1]) / SCALE
    plane = _Plane([_turned([[(x * k, y * k) for x, y in r] for r in rings]) for rings in (one, other)])
    area = lambda inside: float(sum(Fraction(p[0] * q[1] - q[0] * p[1]) for p, q in plane.border(inside)) / 2) / (SCALE * k) ** 2
    return area(lambda w: w[0] != 0), area(lambda w: w[1] != 0), area(lambda w: w[0] != 0 and w[1] != 0)


def iou(one: list[Ring], other: list[Ring]) -> float:
    a, b, shared = areas(one, other)
    return shared / (a + b - shared) if a + b > shared else 0.0


def _padded(points: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rings of ``n`` points from ``first`` on as rows of one width, which the first point fills: sides of no length."""
    k = np.arange(max(int(n.max(initial=1)), 1))
    return points[first[:, None] + np.where(k < n[:, None], k, 0)]


def _sides(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of padded rings: which points are real, and for each the one before and the one after."""
    i, last = np.arange(p.shape[1])[None, :], n[:, None]
    at = lambda k: np.take_along_axis(p, k[:, :, None], axis=1)
    return i < last, at(np.where(i > 0, np.where(i < last, i - 1, 0), last - 1)), at(np.where(i + 1 < last, i + 1, 0))


def _turn(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (b[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (b[..., 0] - o[..., 0])


def _plain(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether padded rings surely pass no point twice: convex ones, and those whose sides meet at their ends only."""
    real, before, after = _sides(p, n)
    turn = np.where(real, _turn(before, p, after), 0.0)
    above = lambda a, b: (a[..., 0] > b[..., 0]) | ((a[..., 0] == b[..., 0]) & (a[..., 1] > b[..., 1]))
    peaks = (real & above(p, before) & ~above(after, p)).sum(axis=1)
    whole = (n > 2) & ~(real & (p == after).all(axis=2)).any(axis=1)
    out = whole & (peaks == 1) & ((turn >= 0).all(axis=1) | (turn <= 0).all(axis=1))
    rest = np.nonzero(whole & ~out)[0]
    if len(rest):
        a, b, m, real = p[rest], after[rest], n[rest][:, None, None], real[rest]
        i, j = np.arange(p.shape[1])[None, :, None], np.arange(p.shape[1])[None, None, :]
        near = (j == i + 1) | ((i == 0) & (j == m - 1))
        own, other = (a[:, :, None], b[:, :, None]), (a[:, None], b[:, None])
        split = lambda u, v: np.sign(_turn(*u, v[0])) * np.sign(_turn(*u, v[1])) > 0
        low, high = np.minimum(a, b), np.maximum(a, b)
        away = (low[:, :, None] > high[:, None]).any(axis=3) | (high[:, :, None] < low[:, None]).any(axis=3)
        met = (i < j) & ~near & real[:, :, None] & real[:, None] & ~(split(own, other) | split(other, own) | away)
        # a side that goes back along the one before
        back = real & (turn[rest] == 0) & (((before[rest] - a) * (b - a)).sum(axis=2) > 0)
        out[rest] = ~(met.any(axis=(1, 2)) | back.any(axis=1))
    return out


def _shared(p: np.ndarray, q: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, ...]:
    """The areas of padded rings that pass no point twice, and of what each two share: what is below a side of one and
    below a side of the other, added up by the ways that the sides go."""
    corner = np.minimum(p.min(axis=1), q.min(axis=1))[:, None]
    p, q = p - corner, q - corner
    # sides of the padding have no length
    (_, _, p2), (_, _, q2) = _sides(p, n), _sides(q, m)
    whole = lambda a, b: (a[..., 0] * b[..., 1] - b[..., 0] * a[..., 1]).sum(axis=1) / 2
    one, other = whole(p, p2), whole(q, q2)
    a, b, c, d = p[:, :, None], p2[:, :, None], q[:, None], q2[:, None]
    left = np.maximum(np.minimum(a[..., 0], b[..., 0]), np.minimum(c[..., 0], d[..., 0]))
    wide = np.maximum(np.minimum(np.maximum(a[..., 0], b[..., 0]), np.maximum(c[..., 0], d[..., 0])) - left, 0.0)

    def heights(u, v):
        run = v[..., 0] - u[..., 0]
        slope = (v[..., 1] - u[..., 1]) / np.where(run == 0, 1.0, run)
        return u[..., 1] + (left - u[..., 0]) * slope, u[..., 1] + (left + wide - u[..., 0]) * slope, np.sign(run)

    (e1, e2, s), (f1, f2, t) = heights(a, b), heights(c, d)
    g1, g2 = e1 - f1, e2 - f2
    size = np.abs(g1) + np.abs(g2)
    # the mean of what lies between two sides, which may cross
    between = np.where(g1 * g2 < 0, (g1 * g1 + g2 * g2) / np.where(size > 0, size, 1.0), size) / 2
    sums = (s * t * wide * ((e1 + e2 + f1 + f2) / 2 - between) / 2).sum(axis=(1, 2))
    return np.abs(one), np.abs(other), np.maximum(sums * np.sign(one) * np.sign(other), 0.0)


def ious(one: tuple, other: tuple, slow) -> list[float]:
    """``iou`` of many pairs of rings, each side (points, first, n): all points one below the other, and for each ring where
    its own begin and how many they are. Rings that pass a point twice are left to ``slow`` (of two rings)."""
    (points, first, n), (points2, first2, m) = one, other
    out = np.zeros(len(n))
    order, i = np.argsort(np.maximum(n, m), kind="stable"), 0
    while i < len(order):
        # as many pairs as fit some memory, the next ones being wider
        most = max(int(max(n[order[i]], m[order[i]])), 1)
        part = order[i : i + max(2**18 // most**2, 1)]
        part = part[np.maximum(n[part], m[part]) <= most + 2]
        i += len(part)
        k, l = n[part], m[part]
        p, q = _padded(points, first[part], k), _padded(points2, first2[part], l)
        plain = _plain(p, k) & _plain(q, l)
        a, b, both = _shared(p, q, k, l)
        joint = a + b - both
        out[part] = np.where(plain & (joint > 0), both / np.where(joint > 0, joint, 1.0), 0.0)
        for j in np.nonzero(~plain)[0].tolist():
            out[part[j]] = slow(list(map(tuple, p[j, : k[j]].tolist())), list(map(tuple, q[j, : l[j]].tolist())))
    return out.tolist()


def is_convex(ring: Ring) -> bool:
    """Whether a ring turns one way only, and goes round once; one of less than three points is."""
    r = [p for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p != q]
    if len(r) < 3:
        return True
    turns = [_cross(a, b, c) for a, b, c in zip(r, r[1:] + r[:1], r[2:] + r[:2], strict=True)]
    peaks = sum(b > a and b >= c for a, b, c in zip(r, r[1:] + r[:1], r[2:] + r[:2], strict=True))
    return peaks == 1 and (min(turns) >= 0 or max(turns) <= 0)


def wkb(polygons: list[list[Ring]]) -> bytes:
    """A polygon with its holes, or a multipolygon of such, as little-endian WKB."""

    def one(rings):
        closed = [[*r, r[0]] for r in rings]
        return struct.pack("<BII", 1, 3, len(closed)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in closed)

    return one(polygons[0]) if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


# concave hulls


def _in_circle(a, b, c, d) -> bool:
    """Whether d is inside the circle through a, b, c (counter-clockwise)."""
    (ax, ay), (bx, by), (cx, cy) = ((p[0] - d[0], p[1] - d[1]) for p in (a, b, c))
    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return ax * (by * cc - bb * cy) - ay * (bx * cc - bb * cx) + aa * (bx * cy - by * cx) > 0


def delaunay(points: list[tuple[int, int]]) -> dict:
    """Delaunay triangles of points of the grid, as {(a, b): c} for each side of each, counter-clockwise; empty if all lie on
    one line. Points come from left to right, each is joined to the sides that it sees, and sides are flipped until
    no circle holds a point."""
    p = sorted(set(points))
    first = next((k for k in range(2, len(p)) if _cross(p[0], p[1], p[k])), None)
    if first is None:
        return {}
    third, after, before = {}, {}, {}

    def add(a, b, c):
        third[a, b], third[b, c], third[c, a] = c, a, b

    def settle(todo):
        while todo:
            a, b = todo.pop()
            c, d = third.get((a, b)), third.get((b, a))
            if c is None or d is None or not _in_circle(a, b, c, d):
                continue
            del third[a, b], third[b, a]
            add(c, a, d)
            add(d, b, c)
            todo += [(a, d), (d, b), (b, c), (c, a)]

    line, tip = p[:first], p[first]
    if _cross(line[0], line[1], tip) < 0:
        line = line[::-1]
    for a, b in zip(line, line[1:], strict=False):
        add(a, b, tip)
    round_ = [*line, tip]
    for a, b in zip(round_, round_[1:] + round_[:1], strict=True):
        after[a], before[b] = b, a
    last = tip
    settle([(tip, a) for a in line])
    for q in p[first + 1 :]:
        left = right = last
        seen = []
        while _cross(right, after[right], q) < 0:
            seen.append((right, after[right]))
            right = after[right]
        while _cross(before[left], left, q) < 0:
            seen.append((before[left], left))
            left = before[left]
        for a, b in seen:
            add(b, a, q)
        after[left], before[q], after[q], before[right] = q, left, right, q
        last = q
        settle(seen)
    return third


def concave_hull(points: list[Point], ratio: float = 0.3) -> tuple[Ring, list[Ring]]:
    """A ring round all points, and the triangles it is made of: of the Delaunay triangles those at the border with its
    longest sides go, as long as a side is longer than the shortest side and ``ratio`` of the way to the longest and the
    ring stays one that passes no point twice. At ratio 1 it is the convex hull. Points on a line give nothing."""
    third = delaunay([(round(x * SCALE), round(y * SCALE)) for x, y in points])
    if not third:
        return [], []
    long = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    sizes = [long(a, b) ** 0.5 for a, b in third]
    least = min(sizes) + ratio * (max(sizes) - min(sizes))
    border = {(a, b) for a, b in third if (b, a) not in third}
    on = {a for a, _ in border}
    queue = [(-long(a, b), a, b) for a, b in border]
    heapq.heapify(queue)
    while queue:
        size, a, b = heapq.heappop(queue)
        if (-size) ** 0.5 <= least:
            break
        c = third[a, b]
        if c in on:
            continue
        on.add(c)
        border.remove((a, b))
        for x, y in ((a, b), (b, c), (c, a)):
            del third[x, y]
        for side in ((a, c), (c, b)):
            border.add(side)
            heapq.heappush(queue, (-long(*side), *side))
    triangles = sorted({tuple(min((a, b, c), (b, c, a), (c, a, b))) for (a, b), c in third.items()})
    return _metres(_rings(list(border))[0]), [_metres(t) for t in triangles]

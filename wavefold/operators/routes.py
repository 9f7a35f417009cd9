"""The packets of a frame: its heaviest east paths, one after the other, and the orphans they take in.

Candidates are the simple paths whose every edge leads east, and that end no farther than half a turn east of where they
begin; longer ones go round the globe and fall apart at their lightest edges into parts of less than a turn, which are
candidates too. They are taken by falling weight, as long as they share no node and no band of longitude and latitude
with one before. Candidates are never listed: from a source, bounds on the rest of a path lead to the heaviest one left,
and a bound is computed anew only when its source comes to the head of the queue. A part of more than half a turn is one
if some way on beside it completes a turn and is cut off first; that is a search in the same graph.

Each frame is one Spark group of edges; arcs and the bins of longitude come with them as columns."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..sources.staging import spread

#: Weights are compared in whole units, of which the frame's largest has so many: sums do not depend on their order.
UNITS = 1 << 40
#: Changes that orphans make to a frame's paths, at most; a fixed value.
ROUNDS = 50


class Frame:
    """Edges {(src, dst): (weight, arc)} that lead east, nodes' (lon, lat), and ``turn``: the bins of longitude from each
    source on, one for each degree."""

    def __init__(self, edges: dict, place: dict, turn: dict, gate: float):
        largest = max((abs(w) for w, _ in edges.values()), default=0.0) or 1.0
        self.units = {e: round(w / largest * UNITS) for e, (w, _) in edges.items()}
        self.arcs = {e: arc for e, (_, arc) in edges.items()}
        self.place, self.turn, self.gate = place, turn, gate
        self.east: dict = {n: [] for n in place}
        self.west: dict = {n: [] for n in place}
        for a, b in sorted(edges):
            self.east[a].append(b)
            self.west[b].append(a)
        self.taken: list[tuple] = []  # (bins, lowest and highest latitude)
        self.used: set = set()

    def ends_east(self, a, b) -> bool:
        """Whether b does not lie west of a by the shorter way; half a turn counts by the numbers' order."""
        d = self.place[a][0] - self.place[b][0]
        return (-d if abs(d) > 180 else d) <= 0

    def shape(self, path) -> tuple:
        """Bins of longitude and range of latitude of a path."""
        lats = [self.place[n][1] for n in path]
        arc = sum(self.arcs[e] for e in zip(path, path[1:], strict=False))
        return set(self.turn[path[0]][: int(arc) + 1]), min(lats), max(lats)

    def meets(self, one: tuple, other: tuple) -> bool:
        return max(one[1], other[1]) - min(one[2], other[2]) <= self.gate and not one[0].isdisjoint(other[0])

    def zones(self, start) -> list[tuple]:
        """For each path taken the degrees east of ``start`` from which another shares its longitudes, and its latitudes."""
        turn = self.turn[start]
        found = ((next((k for k, b in enumerate(turn) if b in bins), None), low, high) for bins, low, high in self.taken)
        return [z for z in found if z[0] is not None]

    def barred(self, zones, arc: float, low: float, high: float) -> bool:
        return any(arc >= k and max(low, l) - min(high, h) <= self.gate for k, l, h in zones)

    # candidates of half a turn at most

    def rest(self, start, zones) -> dict:
        """For each node that paths from ``start`` reach the heaviest way on from there, of one edge or more."""
        y = self.place[start][1]
        out: dict = {}
        todo = [(start, 0.0)]
        while todo:
            n, arc = todo[-1]
            if n in out:
                todo.pop()
                continue
            steps = []
            for x in self.east[n]:
                to, lats = arc + self.arcs[n, x], (y, self.place[n][1], self.place[x][1])
                if x not in self.used and to < 360 and self.ends_east(start, x) and not self.barred(zones, to - 1e-9, min(lats), max(lats)):
                    steps.append((x, to))
            open_ = [s for s in steps if s[0] not in out]
            if open_:
                todo += open_
                continue
            out[n] = max((self.units[n, x] + max(out[x], 0) for x, _ in steps), default=-math.inf)
            todo.pop()
        return out

    def best_from(self, start):
        """(weight, path) of the heaviest candidate from ``start`` that may be taken; of equal ones the smallest path."""
        zones = self.zones(start)
        rest = self.rest(start, zones)
        y = self.place[start][1]
        heap = [(-rest[start], (start,), 0, 0.0, y, y, False)] if rest[start] > -math.inf else []
        while heap:
            _, path, weight, arc, low, high, ended = heapq.heappop(heap)
            if ended:
                return weight, path
            n = path[-1]
            for x in self.east[n]:
                to = arc + self.arcs[n, x]
                if x in self.used or x not in rest or x in path or not self.ends_east(start, x):
                    continue
                l, h = min(low, self.place[x][1]), max(high, self.place[x][1])
                if self.barred(zones, to, l, h):
                    continue
                w, longer = weight + self.units[n, x], (*path, x)
                heapq.heappush(heap, (-w, longer, w, to, l, h, True))
                if rest[x] > -math.inf:
                    heapq.heappush(heap, (-(w + rest[x]), longer, w, to, l, h, False))
        return None

    # parts of paths that go round

    def goes_on(self, path, cut, forward: bool) -> bool:
        """Whether beyond the edge ``cut`` at the end (or the beginning) of ``path`` a way leads on to a whole turn, no edge
        of which is cut before it."""
        least, own = self.units[cut], set(path)
        at = cut[1] if forward else cut[0]
        if at in own:
            return False
        arc = sum(self.arcs[e] for e in zip(path, path[1:], strict=False)) + self.arcs[cut]
        todo, seen = [(at, arc)], {at}
        while todo:
            n, arc = todo.pop()
            first, last = (path[0], n) if forward else (n, path[-1])
            if 360 <= arc and self.ends_east(first, last):
                return True
            for x in self.east[n] if forward else self.west[n]:
                e = (n, x) if forward else (x, n)
                heavy = self.units[e] >= least if forward else self.units[e] > least
                if heavy and x not in own and x not in seen and arc + self.arcs[e] <= 540 + 1e-9:
                    seen.add(x)
                    todo.append((x, arc + self.arcs[e]))
        return False

    def _span(self, anchor, least: int, forward: bool, strict: bool) -> dict:
        """{node: arc} of what is less than a turn from ``anchor`` over edges of more than (or at least) ``least``."""
        out, todo = {anchor: 0.0}, [anchor]
        while todo:
            n = todo.pop()
            for x in self.east[n] if forward else self.west[n]:
                e = (n, x) if forward else (x, n)
                to = out[n] + self.arcs[e]
                if x not in out and x not in self.used and to < 360 and (self.units[e] > least or not strict and self.units[e] == least):
                    out[x] = to
                    todo.append(x)
        return out

    def best_part(self, cut, forward: bool):
        """(weight, path) of the heaviest part of more than half a turn that ends before the edge ``cut`` (begins after it)."""
        least = self.units[cut]
        anchor = cut[0] if forward else cut[1]
        if anchor in self.used:
            return None
        # nodes by their way to the anchor (from it), over edges that are not cut before it
        span = self._span(anchor, least, not forward, strict=forward)
        fits = lambda e: self.units[e] > least or not forward and self.units[e] == least
        to_end: dict = {}

        def rest(n):
            """The heaviest way on from n to where parts end."""
            if n not in to_end:
                best = 0 if n == anchor and forward else -math.inf
                for x in self.east[n]:
                    e = (n, x)
                    if x in span and fits(e) and (span[x] < span[n] if forward else span[x] > span[n]):
                        after = rest(x) if forward or self.ends_east(anchor, x) else max(rest(x), 0)
                        best = max(best, self.units[e] + after)
                to_end[n] = best
            return to_end[n]

        starts = [n for n in span if n != anchor and span[n] > 0] if forward else [anchor]
        heap = []
        for s in starts:
            if rest(s) > -math.inf and (not forward or not self.ends_east(s, anchor)):
                heapq.heappush(heap, (-rest(s), (s,), 0, 0.0, False))
        while heap:
            _, path, weight, arc, ended = heapq.heappop(heap)
            if ended:
                if self.goes_on(path, cut, forward):
                    return weight, path
                continue
            n = path[-1]
            for x in self.east[n]:
                e = (n, x)
                if x not in span or x in path or not fits(e) or not (span[x] < span[n] if forward else span[x] > span[n]):
                    continue
                longer, w, to = (*path, x), weight + self.units[e], arc + self.arcs[e]
                if any(self.meets(self.shape(longer), t) for t in self.taken):
                    continue
                if x == anchor if forward else not self.ends_east(anchor, x):
                    heapq.heappush(heap, (-w, longer, w, to, True))
                if (x != anchor or not forward) and rest(x) > -math.inf:
                    heapq.heappush(heap, (-(w + rest(x)), longer, w, to, False))
        return None

    def turns(self) -> bool:
        """Whether any way leads round the globe past where it begins."""
        for s in self.place:
            todo, far = [(s, 0.0)], {s: 0.0}
            while todo:
                n, arc = todo.pop()
                for x in self.east[n]:
                    to = arc + self.arcs[n, x]
                    if x == s:
                        continue
                    if to >= 360:
                        return True
                    if to > far.get(x, -1.0):
                        far[x] = to
                        todo.append((x, to))
        return False

    def packets(self) -> list[tuple]:
        """The paths taken, heaviest first."""
        # (weight, what it is of, when it was found, path): one of None is a bound only
        queue = [(-math.inf, (s,), ("from", s), -1, None) for s in self.place if self.east[s]]
        if self.turns():
            queue += [(-math.inf, (), ("part", e, forward), -1, None) for e in sorted(self.units) for forward in (True, False)]
        heapq.heapify(queue)
        out: list[tuple] = []
        while queue:
            _, _, of, when, path = heapq.heappop(queue)
            # what was the heaviest of its kind still is where nothing since rules it out
            if path is not None and self.used.isdisjoint(path) and not any(self.meets(self.shape(path), t) for t in self.taken[when:]):
                out.append(path)
                self.taken.append(self.shape(path))
                self.used |= set(path)
            if of[0] == "from":
                found = self.best_from(of[1]) if of[1] not in self.used else None
            else:
                found = self.best_part(of[1], of[2])
            if found:
                heapq.heappush(queue, (-found[0], found[1], of, len(out), found[1]))
        return out

    def adopt(self, paths: list[tuple]) -> list[list]:
        """Nodes that no path has join one over their heaviest edge to a node of a path within the gate of latitude: where
        that node is the path's end on their side, or in place of a lighter arm. What loses, or would make paths meet,
        goes for good. One change a round, the smallest node first."""
        paths = [list(p) for p in paths]
        lost: set = set()
        for _ in range(ROUNDS):
            held = {n: p for p in paths for n in p}
            change = None
            for o in sorted(set(self.place) - set(held) - lost):
                near = [(self.units[e], n) for e, n in [*(((o, x), x) for x in self.east[o]), *(((x, o), x) for x in self.west[o])] if n in held and abs(self.place[n][1] - self.place[o][1]) <= self.gate]
                if near:
                    change = (o, *max(near, key=lambda c: (c[0], -c[1])))
                    break
            if change is None:
                break
            o, weight, n = change
            path = held[n]
            i, to_east = path.index(n), (n, o) in self.units
            arm = path[i:] if to_east else path[: i + 1]
            new = [*path[: i + 1], o] if to_east else [o, *path[i:]]
            if weight <= sum(self.units[e] for e in zip(arm, arm[1:], strict=False)) or any(self.meets(self.shape(new), self.shape(p)) for p in paths if p is not path):
                lost.add(o)
            else:
                paths[paths.index(path)] = new
        return paths


def packets(edges: DataFrame, gate: float = 15.0) -> DataFrame:
    """(time, rwp_id, pos, node): the packets of each frame, numbered from 1 as they were taken, from edges (time, src, dst,
    arc, weight, lon1, lat1, lon2, lat2) that lead east."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = {(int(a), int(b)): (float(w), float(arc)) for a, b, w, arc in zip(pdf["src"], pdf["dst"], pdf["weight"], pdf["arc"], strict=True)}
        place = {int(n): (float(x), float(y)) for s, lon, lat in (("src", "lon1", "lat1"), ("dst", "lon2", "lat2")) for n, x, y in zip(pdf[s], pdf[lon], pdf[lat], strict=True)}
        turn = {int(n): t.tolist() for n, t in zip(pdf["src"], pdf["turn"], strict=True)}
        frame = Frame(e, place, turn, gate)
        rows = [(i + 1, k, n) for i, p in enumerate(frame.adopt(frame.packets())) for k, n in enumerate(p)]
        return pd.DataFrame(rows, columns=["rwp_id", "pos", "node"], dtype="int64").assign(time=pdf["time"].iloc[0])[["time", "rwp_id", "pos", "node"]]

    return spread(edges.withColumn("turn", geo.arc_bins("lon1", F.lit(359.0))), "time").groupBy("time").applyInPandas(run, "time int, rwp_id long, pos long, node long")

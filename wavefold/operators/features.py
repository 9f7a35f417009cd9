"""Feature tracks: crests and troughs followed by the overlap of their footprints, in batch and as a stream.

Of the features of a time step each goes on from the live feature of the step before that it overlaps most, so that a
live feature may have several that go on from it: the best is its track's next step, the others split off. Strong
features come first; weak ones recover live features that no strong one goes on from, for a few steps in a row. What is
live in a step depends on the step before; in batch all steps are settled together, in rounds that end when none changes
any more: a round settles at least one step of time more, and most features are settled by the first ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import geo
from . import frames, shapes

#: (run, time, id, node_type, lon, lat, scalar, ring, strength) in; one row for each step of a track out.
STEPS = "run string, track_id string, parent_id string, time long, id long, lon double, lat double, recovered boolean"
_KEY = ["run", "time", "id"]


def _iou(a: list, b: list) -> float:
    """To nine places, so that equal overlaps are equal whichever way they lie. Rings that are not convex take the longer way."""
    return round(frames.iou(a, b) if shapes.is_convex(a) and shapes.is_convex(b) else shapes.iou([a], [b]), 9)


def _flat(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All points of rings, where each ring begins, and how many points it has."""
    n, p = pa.compute.list_value_length(rings).to_numpy(zero_copy_only=False), rings.flatten()
    return np.stack([p.field(c).to_numpy(zero_copy_only=False) for c in "xy"], axis=1), np.cumsum(n) - n, n


def pairs(features: DataFrame, most_shift: float | None = 20.0) -> DataFrame:
    """(run, time, id, before, iou) for features of adjacent steps of one run and type whose footprints overlap, and which
    are at most ``most_shift`` degrees apart; ``before`` is the id in the step before. Footprints meet by the cells
    of a grid as wide as the widest of them, each pair in the cell of the lower left corner of what they share."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = features.select(*_KEY, "node_type", "lon", "lat", "ring", F.array_min(xs).alias("x1"), F.array_max(xs).alias("x2"), F.array_min(ys).alias("y1"), F.array_max(ys).alias("y2"))
    widest = box.agg(F.max(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0] or 1.0
    at = lambda c: F.floor(F.col(c) / widest)
    cells = box.withColumn("cx", F.explode(F.sequence(at("x1"), at("x2")))).withColumn("cy", F.explode(F.sequence(at("y1"), at("y2"))))
    old = cells.select("run", (F.col("time") + 1).alias("time"), "node_type", "cx", "cy", *(F.col(c).alias(f"{c}_b") for c in ("id", "lon", "lat", "ring", "x1", "x2", "y1", "y2")))
    # rows with rings, each as often as it has cells, do not go through the driver
    both = cells.join(old.hint("merge"), ["run", "time", "node_type", "cx", "cy"])
    low = lambda c: F.greatest(f"{c}1", f"{c}1_b")
    both = both.filter((low("x") < F.least("x2", "x2_b")) & (low("y") < F.least("y2", "y2_b")) & (F.floor(low("x") / widest) == F.col("cx")) & (F.floor(low("y") / widest) == F.col("cy")))
    if most_shift is not None:
        dlon, dlat = geo.signed_east("lon_b", "lon"), F.col("lat") - F.col("lat_b")
        both = both.filter(F.sqrt(dlon * dlon + dlat * dlat) <= most_shift)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = (_flat(batch.column(c)) for c in ("ring", "ring_b"))
            found = pa.array([round(x, 9) for x in shapes.ious(*rings, _iou)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], found], names=[*_KEY, "before", "iou"])

    scored = both.select(*_KEY, F.col("id_b").alias("before"), "ring", "ring_b").mapInArrow(score, "run string, time long, id long, before long, iou double")
    return scored.filter("iou > 0")


def _claims(near: DataFrame) -> DataFrame:
    """For each feature the one it goes on from, (run, time, id, before, iou, nth): of greatest overlap, ties to the larger
    id; nth counts those that go on from one, from 1, in the same order."""
    best = near.groupBy(*_KEY).agg(F.max(F.struct("iou", "before")).alias("x")).select(*_KEY, "x.before", "x.iou")
    w = Window.partitionBy("run", "time", "before").orderBy(F.col("iou").desc(), F.col("id").desc())
    return best.withColumn("nth", F.row_number().over(w))


def settle(features: DataFrame, near: DataFrame, save, *, budget: int = 2, band: tuple[float, float] | None = None, min_split: float = 0.05) -> DataFrame:
    """(run, time, id, before, nth, weak, lon, lat): the features that are steps of tracks. ``before`` is null for a birth;
    ``weak`` is how many recovered steps in a row end with it."""
    inside = F.lit(True) if band is None else F.col("lat").between(*band)
    begin = features.groupBy("run").agg(F.min("time").alias("begin"))
    own = save(features.join(begin, "run").select(*_KEY, "lon", "lat", (F.col("strength") == "strong").alias("strong"), inside.alias("inside"), (F.col("time") == F.col("begin")).alias("first")))
    kinds = save(near.join(own.select(*_KEY, "strong"), _KEY))
    live = own.filter("strong AND (inside OR first)").select(*_KEY, F.lit(0).alias("weak"))
    while True:
        heads = live.select("run", (F.col("time") + 1).alias("time"), F.col("id").alias("before"), F.col("weak").alias("weak_b"))
        met = save(kinds.join(heads, ["run", "time", "before"]))
        strong = save(_claims(met.filter("strong").drop("strong", "weak_b")))
        left = met.filter("NOT strong").join(strong.select("run", "time", "before").distinct(), ["run", "time", "before"], "left_anti")
        weak = _claims(left.drop("strong", "weak_b")).join(heads, ["run", "time", "before"]).filter(F.col("weak_b") < budget)
        claims = strong.withColumn("weak", F.lit(0)).unionByName(weak.withColumn("weak", F.col("weak_b") + 1).drop("weak_b"))
        at = own.join(claims, _KEY, "left")
        goes = F.when(F.col("before").isNotNull(), F.col("inside") & (~F.col("strong") | (F.col("nth") == 1) | (F.col("iou") >= min_split))).otherwise(F.col("strong") & (F.col("inside") | F.col("first")))
        now = save(at.filter(goes).select(*_KEY, "before", "nth", F.coalesce("weak", F.lit(0)).alias("weak"), "lon", "lat"))
        same = now.select(*_KEY, "weak").join(live, [*_KEY, "weak"])
        n, m, both = now.count(), live.count(), same.count()
        if n == m == both:
            return now
        live = now.select(*_KEY, "weak")


def link(steps: DataFrame, save) -> DataFrame:
    """Settled steps with their tracks, in the form of STEPS, each step once: a track is named by the step it begins with,
    which is found in rounds that double the way back."""
    own = F.concat_ws(":", "time", "id")
    begins = F.col("before").isNull() | (F.col("nth") > 1)
    up = steps.select("run", own.alias("key"), F.when(begins, own).otherwise(F.concat_ws(":", F.col("time") - 1, "before")).alias("to"))
    while True:
        up = save(up)
        more = save(up.join(up.select("run", F.col("key").alias("to"), F.col("to").alias("next")), ["run", "to"]).select("run", "key", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if more.filter("moved").isEmpty():
            break
        up = more.drop("moved")
    named = steps.withColumn("key", own).join(more.select("run", "key", F.col("to").alias("track_id")), ["run", "key"])
    split = named.filter("key = track_id AND before IS NOT NULL").select("run", "track_id", F.concat_ws(":", F.col("time") - 1, "before").alias("key"))
    parents = split.join(more.select("run", "key", F.col("to").alias("parent_id")), ["run", "key"]).select("run", "track_id", "parent_id")
    out = named.join(parents, ["run", "track_id"], "left").select("run", "track_id", "parent_id", "time", "id", "lon", "lat", (F.col("weak") > 0).alias("recovered"))
    return save(out)


def with_history(steps: DataFrame, save) -> DataFrame:
    """Steps of which those that split off have, before their own, all steps of their parents up to there."""
    begin = save(steps.groupBy("run", "track_id").agg(F.max("parent_id").alias("parent_id"), F.min("time").alias("cut")))
    front = begin.filter("parent_id IS NOT NULL").select("run", "track_id", "parent_id", F.col("parent_id").alias("above"), "cut")
    above, lines = begin.select("run", F.col("track_id").alias("above"), F.col("parent_id").alias("next"), F.col("cut").alias("cut_b")), None
    while not front.isEmpty():
        lines = front if lines is None else lines.unionByName(front)
        front = save(front.join(above.filter("next IS NOT NULL"), ["run", "above"]).select("run", "track_id", "parent_id", F.col("next").alias("above"), F.col("cut_b").alias("cut")))
    if lines is None:
        return steps
    old = steps.select("run", F.col("track_id").alias("above"), "time", "id", "lon", "lat", "recovered")
    return steps.unionByName(lines.join(old, ["run", "above"]).filter("time < cut").select(*steps.columns))


def track(features: DataFrame, save, *, most_shift: float | None = 20.0, history: bool = True, **options) -> DataFrame:
    """Steps of all tracks of each run. Seeds are strong features of a run's first step, wherever, and later ones in
    ``band``; a track ends when what goes on from it is outside. ``budget``: recovered steps in a row at most; a
    further strong feature splits off from an overlap of ``min_split`` on. ``history``: splits have their parents' steps
    too. ``save`` cuts lineage."""
    near = save(pairs(features, most_shift))
    steps = link(settle(features, near, save, **options), save)
    return with_history(steps, save) if history else steps


def _near(f: dict, t: dict, most_shift: float | None) -> bool:
    dlon, dlat = (f["lon"] - t["lon"] + 180) % 360 - 180, f["lat"] - t["lat"]
    return t["node_type"] == f["node_type"] and (most_shift is None or (dlon**2 + dlat**2) ** 0.5 <= most_shift)


def _overlaps(steps: list[tuple[list[dict], list[dict]]], most_shift: float | None) -> dict:
    """{(time, id, id before): iou} of the near features of each step and the one before whose boxes meet, all at once."""
    box: dict = {}

    def meet(f: dict, t: dict) -> bool:
        for g in (f, t):
            if id(g) not in box:
                xs, ys = zip(*g["ring"], strict=True)
                box[id(g)] = min(xs), min(ys), max(xs), max(ys)
        (a, b, c, d), (e, g, h, i) = box[id(f)], box[id(t)]
        return a < h and e < c and b < i and g < d

    some = [(f, t) for now, before in steps for f in now if f["ring"] for t in before if t["ring"] and _near(f, t, most_shift) and meet(f, t)]
    if not some:
        return {}
    sides = []
    for rings in zip(*((f["ring"], t["ring"]) for f, t in some), strict=True):
        n = np.array([len(r) for r in rings])
        sides.append((np.array([p for r in rings for p in r], float), np.cumsum(n) - n, n))
    return {(f["time"], f["id"], t["id"]): round(x, 9) for (f, t), x in zip(some, shapes.ious(*sides, _iou), strict=True)}


def advance(live: list[dict], features: list[dict], *, first: bool = False, most_shift: float | None = 20.0, budget: int = 2, band: tuple[float, float] | None = None, min_split: float = 0.05, known: dict | None = None) -> tuple[list[dict], list[dict]]:
    """The same for one step of one run: live features after it, and the steps taken. ``known``: the overlaps, if they are."""
    inside = lambda f: band is None or band[0] <= f["lat"] <= band[1]
    known = _overlaps([(features, live)], most_shift) if known is None else known
    after, steps, taken = [], [], set()

    def step(track_id: str, parent: str | None, f: dict, weak: int) -> None:
        after.append({k: f[k] for k in ("id", "lon", "lat", "ring", "node_type")} | {"track_id": track_id, "parent_id": parent, "weak": weak})
        steps.append({"track_id": track_id, "parent_id": parent, "time": f["time"], "id": f["id"], "lon": f["lon"], "lat": f["lat"], "recovered": weak > 0})

    for strength in ("strong", "weak"):
        claims: dict[int, list] = {}
        free = [t for t in live if t["id"] not in taken]
        for f in (f for f in features if f["strength"] == strength):
            best = max(((o, t["id"], t) for t in free if (o := known.get((f["time"], f["id"], t["id"]), 0.0)) > 0), key=lambda x: x[:2], default=None)
            if best:
                claims.setdefault(best[1], []).append((best[0], f["id"], f, best[2]))
            elif strength == "strong" and (first or inside(f)):
                step(f"{f['time']}:{f['id']}", None, f, 0)
        for name, some in claims.items():
            taken.add(name)
            for nth, (o, _, f, t) in enumerate(sorted(some, key=lambda x: x[:2], reverse=True)):
                weak = 0 if strength == "strong" else t["weak"] + 1
                if inside(f) and weak <= budget and (nth == 0 or weak or o >= min_split):
                    step(*((t["track_id"], t["parent_id"]) if nth == 0 else (f"{f['time']}:{f['id']}", t["track_id"])), f, weak)
    return after, steps


def _rows(pdf: pd.DataFrame) -> list[dict]:
    columns = (pdf[c].tolist() for c in ("time", "id", "node_type", "lon", "lat", "strength", "ring"))
    return [{"time": int(t), "id": int(i), "node_type": kind, "lon": lon, "lat": lat, "strength": strength, "ring": [] if ring is None else list(zip(ring[::2].tolist(), ring[1::2].tolist(), strict=True))} for t, i, kind, lon, lat, strength, ring in zip(*columns, strict=True)]


def phase_velocity(steps: DataFrame, hours: float = 1.0) -> DataFrame:
    """Eastward degrees an hour of each track; null for fewer than two steps."""
    w = Window.partitionBy("run", "track_id").orderBy("time")
    moved = steps.withColumn("d", geo.signed_east(F.lag("lon").over(w), F.col("lon")))
    return moved.groupBy("run", "track_id").agg(F.try_divide(F.sum("d"), (F.max("time") - F.min("time")) * hours).alias("degrees_per_hour"))


def roots(steps: DataFrame, save) -> DataFrame:
    """(run, track_id, root): parents followed to the track that was born, two generations a round."""
    up = steps.groupBy("run", "track_id").agg(F.max("parent_id").alias("parent")).select("run", "track_id", F.coalesce("parent", "track_id").alias("root"))
    while True:
        up = save(up)
        above = up.select("run", F.col("track_id").alias("root"), F.col("root").alias("next"))
        more = save(up.join(above, ["run", "root"], "left").select("run", "track_id", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")))
        if more.filter("moved").isEmpty():
            return more.select("run", "track_id", "root")
        up = more.drop("moved")


#: Strength of a row that is no feature but says that its run has come, up to and with its time. It has to come last.
END = "end"


def ends(features: DataFrame) -> DataFrame:
    """A row of strength ``END`` for each run, to be written behind the run's features."""
    last = features.groupBy("run").agg(F.max("time").alias("time"))
    known = {"run": F.col("run"), "time": F.col("time"), "id": F.lit(0), "strength": F.lit(END)}
    return last.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in features.schema))


def stream_track(features: DataFrame, **options) -> DataFrame:
    """The same steps (without history) from a stream of features. A time step is worked off when a later one of its run
    has come, or a row of strength ``END`` of its time (see ``ends``); rows that come after theirs was worked off are
    returned with a null track_id. The state of a run is the live features and those that wait."""
    columns = [c.split(" ")[0] for c in STEPS.split(", ")]

    def run(key, pdfs, state):
        old = json.loads(state.get[0]) if state.exists else {"live": [], "wait": [], "done": None}
        late, wait = [], [x | {"ring": [tuple(p) for p in x["ring"]]} for x in old["wait"]]
        live = [x | {"ring": [tuple(p) for p in x["ring"]]} for x in old["live"]]
        end = []
        for pdf in pdfs:
            for r in _rows(pdf):
                if r["strength"] == END:
                    end.append(r["time"])
                    continue
                (wait if old["done"] is None or r["time"] > old["done"] else late).append(r)
        out = [{"track_id": None, "parent_id": None, "time": r["time"], "id": r["id"], "lon": r["lon"], "lat": r["lat"], "recovered": False} for r in late]
        done = old["done"]
        if wait:
            last = max(*(r["time"] for r in wait), *(t + 1 for t in end), wait[0]["time"])
            by_time: dict[int, list] = {}
            for r in wait:
                by_time.setdefault(r["time"], []).append(r)
            first = min(by_time) if done is None else None
            times = range(first if done is None else done + 1, last)
            known = _overlaps([(by_time.get(t, []), live if t == times[0] else by_time.get(t - 1, [])) for t in times], options.get("most_shift", 20.0))
            for t in times:
                live, steps = advance(live, sorted(by_time.get(t, ()), key=lambda r: r["id"]), first=t == first, known=known, **options)
                out += steps
                done = t
            wait = [r for r in wait if r["time"] >= last]
        state.update((json.dumps({"live": live, "wait": wait, "done": done}),))
        yield pd.DataFrame({"run": key[0]} | {c: [r[c] for r in out] for c in columns[1:]}, columns=columns)

    # rings go to Python as numbers, x and y in turn
    flat = F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias("ring")
    features = features.select("run", "time", "id", "node_type", "lon", "lat", "strength", flat)
    return features.groupBy("run").applyInPandasWithState(run, STEPS, "state string", "append", "NoTimeout")

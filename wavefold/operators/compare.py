"""Masks on the pixel grid and how well they agree. A mask is a table of the pixels where it holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import geo

PIXEL = ["time", "row", "col"]


def pixel_grid(spark, n: int, half_width: float, hemisphere: str = "north") -> DataFrame:
    """(row, col, lat, lon) of an n x n raster's pixel centres, row 0 at the top."""
    step = 2 * half_width / n
    axis = spark.range(n)
    x, y = -half_width + (F.col("col") + 0.5) * step, half_width - (F.col("row") + 0.5) * step
    lat, lon = geo.from_stereographic(x, y, hemisphere)
    grid = axis.select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("col"))
    return grid.select("row", "col", lat.alias("lat"), F.pmod(lon, F.lit(360.0)).alias("lon"))


def in_band(df: DataFrame, low: float = 20.0, high: float = 80.0) -> DataFrame:
    return df.filter(F.col("lat").isNotNull() & F.col("lat").between(low, high))


def envelope_mask(envelope: DataFrame, threshold: float = 14.0) -> DataFrame:
    return envelope.filter(F.col("envelope") >= threshold)


def nearest_cells(grid: DataFrame, field: DataFrame) -> DataFrame:
    """(row, col, lat_idx, lon_idx): the field's cell nearest to each of the ``grid``'s pixels (row, col, lat, lon) by
    latitude and by longitude, the lower one in the middle; pixels beyond the first and last of either have none."""
    axes = []
    for idx, value in (("lat_idx", "lat"), ("lon_idx", "lon")):
        # a row for each latitude or longitude of the field
        rows = sorted((r[1], r[0]) for r in field.groupBy(idx).agg(F.min(value)).collect())
        axes.append((np.array([x for x, _ in rows]), np.array([i for _, i in rows])))

    def find(batches):
        for pdf in batches:
            out = pdf[["row", "col"]].copy()
            there = np.ones(len(pdf), bool)
            for (at, idx), value in zip(axes, ("lat", "lon"), strict=True):
                x = pdf[value].to_numpy(float)
                there &= (x >= at[0]) & (x <= at[-1]) if len(at) else False
                out[f"{value}_idx"] = idx[np.searchsorted((at[1:] + at[:-1]) / 2, x, side="left")] if len(at) else 0
            yield out[there]

    return grid.mapInPandas(find, "row int, col int, lat_idx int, lon_idx int")


def regrid(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """Pixels (time, row, col) of a mask on the field's cells (time, lat_idx, lon_idx), by the pixels' ``cells``."""
    return mask.select("time", "lat_idx", "lon_idx").join(cells, ["lat_idx", "lon_idx"]).select(*PIXEL)


def agreement(hits: DataFrame, reference: DataFrame, thresholds: DataFrame, times: DataFrame, n_pixels: int, cells: DataFrame | None = None) -> DataFrame:
    """(method, threshold, time, shared, joint, iou, agree, only_a, only_b) of masks at all ``thresholds`` (method,
    threshold, suffix) against one reference mask. A row of ``hits`` (method, threshold, time, row, col) is a pixel of the
    mask at its threshold and, for methods with ``suffix``, of those at all lower ones: such a pixel is counted once, at the
    highest threshold that it reaches, and the counts are summed from there down. With ``cells``, each pixel's cell of
    the field (row, col, lat_idx, lon_idx), the reference is a mask of the field (time, lat_idx, lon_idx), whose pixels are
    counted by cell and never listed."""
    hits = hits.select("method", "threshold", *PIXEL).distinct()
    if cells is None:
        at, known = PIXEL, reference.select(*PIXEL).distinct()
        total = known.groupBy("time").agg(F.count("*").alias("total"))
    else:
        at, known = ["time", "lat_idx", "lon_idx"], reference.select("time", "lat_idx", "lon_idx").distinct()
        hits = hits.join(cells, ["row", "col"], "left")
        total = known.join(cells.groupBy("lat_idx", "lon_idx").agg(F.count("*").alias("pixels")), ["lat_idx", "lon_idx"]).groupBy("time").agg(F.sum("pixels").alias("total"))
    n = hits.join(known.withColumn("there", F.lit(1)), at, "left").groupBy("method", "threshold", "time").agg(F.count("*").alias("n"), F.count("there").alias("shared"))
    # some thresholds for each time step, whatever the raster's size
    grid = times.select("time").distinct().join(thresholds, how="cross").join(total, "time", "left").join(n, ["method", "threshold", "time"], "left")
    down = Window.partitionBy("method", "time").orderBy(F.col("threshold").desc())
    at = lambda c: F.when(F.col("suffix"), F.sum(F.coalesce(c, F.lit(0))).over(down)).otherwise(F.coalesce(c, F.lit(0)))
    out = grid.select("method", "threshold", "time", F.coalesce("total", F.lit(0)).alias("total"), at("n").alias("n"), at("shared").alias("shared"))
    out = out.withColumn("joint", F.col("n") + F.col("total") - F.col("shared"))
    only = lambda c: (F.col(c) - F.col("shared")) / F.lit(float(max(n_pixels, 1)))
    return out.select("method", "threshold", "time", "shared", "joint", F.coalesce(F.try_divide("shared", "joint"), F.lit(1.0)).alias("iou"), ((F.col("n") > 0) == (F.col("total") > 0)).alias("agree"), only("n").alias("only_a"), only("total").alias("only_b"))


def levelled(pixels: DataFrame, method: str, thresholds: list[float]) -> DataFrame:
    """Hits of pixels (time, row, col, level), at the highest of the ``thresholds`` that the pixel's level reaches."""
    top = pixels.groupBy(*PIXEL).agg(F.max("level").alias("level"))
    reached = F.array_max(F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: t <= F.col("level")))
    return top.select(F.lit(method).alias("method"), reached.alias("threshold"), *PIXEL).filter("threshold IS NOT NULL")


def _both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    left, right = a.select(*keys).distinct().withColumn("a", F.lit(True)), b.select(*keys).distinct().withColumn("b", F.lit(True))
    return left.join(right, keys, "full_outer").select(*keys, F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))


def iou(a: DataFrame, b: DataFrame, times: DataFrame, keys: list[str] = PIXEL) -> DataFrame:
    """Per time step: shared and joint pixels, their ratio (1 where both are empty), and whether both detect."""
    n = _both(a, b, keys).groupBy("time").agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count("*").alias("joint"), F.max(F.col("a").cast("int")).alias("has_a"), F.max(F.col("b").cast("int")).alias("has_b"))
    out = times.join(n, "time", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("time", zero("shared").cast("long").alias("shared"), zero("joint").cast("long").alias("joint"), F.coalesce(F.try_divide("shared", "joint"), F.lit(1.0)).alias("iou"), (zero("has_a") == zero("has_b")).alias("agree"))


def disagreement(a: DataFrame, b: DataFrame, n_pixels: int, keys: list[str] = PIXEL) -> DataFrame:
    """Shares of the band's pixels that only one of the masks has, per time step."""
    n = _both(a, b, keys).groupBy("time").agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    return n.select("time", (F.col("only_a") / n_pixels).alias("only_a"), (F.col("only_b") / n_pixels).alias("only_b"))


def frequency(a: DataFrame, b: DataFrame, n_times: int) -> DataFrame:
    """Per pixel: shares of time steps in which both, only a, or only b hold."""
    n = _both(a, b, PIXEL).groupBy("row", "col")
    return n.agg((F.count_if(F.col("a") & F.col("b")) / n_times).alias("both"), (F.count_if(F.col("a") & ~F.col("b")) / n_times).alias("only_a"), (F.count_if(F.col("b") & ~F.col("a")) / n_times).alias("only_b"))


def latitude_shares(a: DataFrame, b: DataFrame, lats: DataFrame, n_times: int, *, width: float = 5.0, low: float = 20.0, high: float = 80.0) -> DataFrame:
    """(band, both, only_a, only_b): shares of each band's pixels over all time steps; bands without either mask too."""
    near = lats.filter((F.col("lat") >= low) & (F.col("lat") < high))
    size = near.groupBy(geo.grid_bin("lat", width).alias("band")).agg(F.count("*").alias("n"))
    n = by_latitude(a, b, near, width)
    share = lambda c: F.coalesce(F.col(c) / (F.col("n") * n_times), F.lit(0.0)).alias(c)
    return size.join(n, "band", "left").select("band", share("both"), share("only_a"), share("only_b"))


def by_latitude(a: DataFrame, b: DataFrame, lats: DataFrame, width: float = 5.0) -> DataFrame:
    """Pixels of each kind in bands of latitude, over all time steps. ``lats`` has (row, col, lat)."""
    at = _both(a, b, PIXEL).join(lats, ["row", "col"]).groupBy(geo.grid_bin("lat", width).alias("band"))
    return at.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


def sweep(results: DataFrame) -> DataFrame:
    """Means over time for each method and threshold; results has (method, threshold, time, iou, agree), and shares of
    pixels that one mask alone has (only_a, only_b), or not."""
    more = [F.avg(c).alias(f"mean_{c}") for c in ("only_a", "only_b") if c in results.columns]
    return results.groupBy("method", "threshold").agg(F.avg("iou").alias("mean_iou"), F.avg(F.col("agree").cast("double")).alias("agreement"), *more, F.count("*").alias("n"))


def save_sweep(swept: DataFrame, path: str) -> None:
    """As CSV with a header, in order."""
    swept.orderBy("method", "threshold").write.mode("overwrite").csv(path, header=True)


def best_threshold(swept: DataFrame) -> DataFrame:
    return swept.groupBy("method").agg(F.max_by("threshold", F.struct("mean_iou", -F.col("threshold"))).alias("threshold"), F.max("mean_iou").alias("mean_iou"))

"""Points in zones: boxes and polygons, with holes and across the antimeridian.

Zones are covered by cells of a hierarchy, large ones within and small ones along the border, at most ``cells`` for a
zone whatever its size. A point looks up the cells that hold it, one for each size in use. A point in an inner cell
is in the zone; only points in border cells are tested against the zone's outline.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.sources.tables import cut

#: A cell is cut into 4 x 4, down to some 40 metres.
SPLIT, LEVELS = 4, 10
#: Cells are taken a little larger than they are, so that rounding never leaves a point between two.
MARGIN = 1e-9
#: Cells at the rim of the map reach this far; points beyond it are in no zone.
FAR = 1e9

OUTSIDE, BORDER, INSIDE = 0, 1, 2


def _rects(level: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """South, north, west and east of cells."""
    n = SPLIT**level
    south, west = y * (180 / n) - 90 - MARGIN, x * (360 / n) - 180 - MARGIN
    north, east = (y + 1) * (180 / n) - 90 + MARGIN, (x + 1) * (360 / n) - 180 + MARGIN
    return np.where(y == 0, -FAR, south), np.where(y == n - 1, FAR, north), np.where(x == 0, -FAR, west), np.where(x == n - 1, FAR, east)


def _box_relation(rects: tuple, box: tuple[float, float, float, float]) -> np.ndarray:
    south, north, west, east = rects
    low, high, left, right = box
    apart = (north < low) | (south > high) | (east < left) | (west > right)
    within = (south >= low) & (north <= high) & (west >= left) & (east <= right)
    return np.where(apart, OUTSIDE, np.where(within, INSIDE, BORDER))


def _ring_relation(rects: tuple, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Cells that an edge of the ring meets are on its border; of the others a corner decides."""
    if len(lat) == 0:
        return np.full(len(rects[0]), OUTSIDE)
    if np.isnan(lat).any() or np.isnan(lon).any():
        return np.full(len(rects[0]), BORDER)
    lat2, lon2 = np.roll(lat, -1), np.roll(lon, -1)
    low, high, left, right = np.minimum(lat, lat2), np.maximum(lat, lat2), np.minimum(lon, lon2), np.maximum(lon, lon2)
    out = []
    for south, north, west, east in zip(*rects, strict=True):
        near = np.flatnonzero((low <= north) & (high >= south) & (left <= east) & (right >= west))
        side = [(lon2[near] - lon[near]) * (a - lat[near]) - (lat2[near] - lat[near]) * (o - lon[near]) for a in (south, north) for o in (west, east)]
        if len(near) and ((np.minimum.reduce(side) <= 0) & (np.maximum.reduce(side) >= 0)).any():
            out.append(BORDER)
            continue
        a, o = (south + north) / 2, (west + east) / 2
        over = (lat > a) != (lat2 > a)
        crossings = o < (lon2[over] - lon[over]) * (a - lat[over]) / (lat2[over] - lat[over]) + lon[over]
        out.append(INSIDE if crossings.sum() % 2 else OUTSIDE)
    return np.array(out)


def _relation(rects: tuple, box: tuple, outline: tuple | None, holes: list[tuple]) -> np.ndarray:
    out = _box_relation(rects, box)
    if outline is not None:
        out = np.minimum(out, _ring_relation(rects, *outline))
    for hole in holes:
        out = np.minimum(out, 2 - _ring_relation(rects, *hole))
    return out


def covering(box: tuple[float, float, float, float], outline: tuple | None, holes: list[tuple], most: int, past: bool = False) -> list[tuple[int, int, int, bool]]:
    """Cells (level, x, y, inner) of a zone, ``most`` at most: the largest border cells are cut first.

    box: min_lat, max_lat, min_lon, max_lon. past: the zone goes on beyond the antimeridian, where 180 and more of it lie.
    """
    shifts = (0, 360) if past else (0,)
    done, border = [], [(0, 0, 0)]
    while border and border[0][0] < LEVELS and len(done) + len(border) - 1 + SPLIT**2 <= most:
        level, x, y = border.pop(0)
        step = np.arange(SPLIT)
        xs, ys = (x * SPLIT + step).repeat(SPLIT), np.tile(y * SPLIT + step, SPLIT)
        rects = _rects(level + 1, xs, ys)
        each = [_relation((*rects[:2], rects[2] + by, rects[3] + by), box, outline, holes) for by in shifts]
        for cx, cy, relation in zip(xs.tolist(), ys.tolist(), np.maximum.reduce(each).tolist(), strict=True):
            if relation == INSIDE:
                done.append((level + 1, cx, cy, True))
            elif relation == BORDER:
                border.append((level + 1, cx, cy))
    return done + [(*cell, False) for cell in border]


def _cover(most: int):
    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for z, low, high, left, right, past, polygon, lats, lons in zip(*(batch[c] for c in batch.columns), strict=True):
                rings = [(np.array(a, float), np.array(o, float)) for a, o in zip(lats, lons, strict=True)]
                outline = rings.pop(0) if polygon else None
                out += [(z, *cell) for cell in covering((low, high, left, right), outline, rings, most, past)]
            yield pd.DataFrame(out, columns=["z", "level", "x", "y", "inner"])

    return cover


def in_polygon(lat: Column, lon: Column, polygon: Column) -> Column:
    """Whether a ring of (lat, lon) structs holds a point: an odd number of its edges lie to the east of it."""
    n = F.size(polygon)
    at = lambda i: F.get(polygon, i)

    def crossed(i: Column) -> Column:
        a, b = at(i), at((i + 1) % n)
        return ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"])

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crossed)) % 2 == 1


def assign_zone(points: DataFrame, zones: DataFrame, cells: int = 64, id_col: str = "id") -> DataFrame:
    """points (id, lat, lon) with the zone that holds each; the first by name if several do, null if none.

    zones: zone, min_lat, max_lat, min_lon, max_lon, and optionally polygon (array of lat, lon structs; null: the whole
    box) and holes (array of such rings; null or empty: none). Borders of boxes belong to them. A zone whose min_lon is
    above its max_lon goes on past the antimeridian, its rings too. Points without a place, or with NaN in it, and zones
    without a whole box have none. A zone has at most ``cells`` cells (16 at least).
    """
    if cells < SPLIT**2:
        raise ValueError(f"a zone needs {SPLIT**2} cells")
    shape = "array<struct<lat:double,lon:double>>"
    polygon = F.col("polygon").cast(shape) if "polygon" in zones.columns else F.lit(None).cast(shape)
    holes = F.col("holes").cast(f"array<{shape}>") if "holes" in zones.columns else F.lit(None).cast(f"array<{shape}>")
    box = [F.col(c).cast("double").alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    east = F.when(F.col("min_lon") > F.col("max_lon"), F.col("max_lon") + 360).otherwise(F.col("max_lon")).cast("double")
    past = (F.col("east") > F.col("max_lon")) & F.col("min_lon").isNotNull()
    along = lambda lon: F.when(past & (lon < F.col("min_lon")), lon + 360).otherwise(lon)
    ring = lambda r: F.transform(r, lambda p: F.struct(p["lat"].alias("lat"), along(p["lon"]).alias("lon")))
    shapes = zones.select("zone", *box, east.alias("east"), polygon.alias("polygon"), F.coalesce(holes, F.array().cast(f"array<{shape}>")).alias("holes"))
    shapes = shapes.filter("min_lat <= max_lat and min_lon <= east")
    shapes = shapes.withColumn("polygon", ring(F.col("polygon"))).withColumn("holes", F.transform(F.filter("holes", lambda h: h.isNotNull()), ring))
    # zones are numbered as they are written, and keep their numbers: names may repeat
    shapes = cut(shapes.withColumn("z", F.monotonically_increasing_id()), "zones")
    rings = F.when(F.col("polygon").isNull(), F.col("holes")).otherwise(F.concat(F.array("polygon"), "holes"))
    part = lambda c: F.transform("rings", lambda r: F.transform(r, lambda p: p[c])).alias(f"{c}s")
    outlines = shapes.withColumn("rings", rings).select("z", "min_lat", "max_lat", "min_lon", "east", past.alias("past"), F.col("polygon").isNotNull().alias("has_polygon"), part("lat"), part("lon"))
    cover = cut(outlines.mapInPandas(_cover(cells), "z long, level int, x long, y long, inner boolean"), "covering")
    # at most one size for each level
    levels = sorted(r.level for r in cover.select("level").distinct().collect())

    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    places = points.select(F.col(id_col).alias("id"), lat.alias("lat"), lon.alias("lon")).filter("abs(lat) <= 1e9 and abs(lon) <= 1e9")
    cell = lambda c, span, n: F.least(F.greatest(F.floor((F.col(c) / span + 0.5) * n), F.lit(0)), F.lit(n - 1))
    sizes = [F.struct(F.lit(v).alias("level"), cell("lon", 360, SPLIT**v).alias("x"), cell("lat", 180, SPLIT**v).alias("y")) for v in levels]
    sizes = F.array(*sizes) if sizes else F.array().cast("array<struct<level:int,x:bigint,y:bigint>>")
    near = places.withColumn("c", F.explode(sizes)).select("id", "lat", "lon", "c.*").join(cover, ["level", "x", "y"])
    inner = near.filter("inner").join(shapes.select("z", "zone"), "z").select("id", "lat", "lon", "zone")
    border = near.filter("not inner").join(shapes, "z").withColumn("at", along(F.col("lon")))
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("at").between(F.col("min_lon"), F.col("east"))
    inside &= F.col("polygon").isNull() | in_polygon(F.col("lat"), F.col("at"), F.col("polygon"))
    inside &= ~F.exists("holes", lambda h: in_polygon(F.col("lat"), F.col("at"), h))
    found = inner.unionByName(border.filter(inside).select("id", "lat", "lon", "zone"))
    best = found.groupBy("id", "lat", "lon").agg(F.min("zone").alias("zone")).select(F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), "zone")
    same = points[id_col].eqNullSafe(F.col("b_id")) & (points["lat"].cast("double") == F.col("b_lat")) & (points["lon"].cast("double") == F.col("b_lon"))
    return points.join(best, same, "left").drop("b_id", "b_lat", "b_lon")

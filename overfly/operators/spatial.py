"""Spatial joins: point in map, nearest neighbour and radius, on grid cells instead of all pairs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from .store import checkpointed


def cell_size(radius_m: float, max_abs_lat: float) -> tuple[float, float]:
    """Degrees of latitude and longitude that span at least the radius everywhere up to that latitude; longitudes divide the circle evenly."""
    squeeze = math.cos(math.radians(min(90.0, max_abs_lat + radius_m / K.LATITUDE_M)))
    wide = radius_m / (K.LATITUDE_M * squeeze) if squeeze > 1e-9 else 360.0
    return radius_m / K.LATITUDE_M, 360.0 / max(1, math.floor(360.0 / wide))


def _cells(lat: Column, lon: Column, size: tuple[float, float]) -> tuple[Column, Column]:
    return F.floor(lat / size[0]), F.pmod(F.floor((lon + 180.0) / size[1]), F.lit(round(360.0 / size[1])))


def farthest_north(*sides: tuple[DataFrame, str]) -> float:
    """The largest absolute latitude of any side: one small aggregate each."""
    return max(abs(d.agg(F.max(F.abs(F.col(c)))).first()[0] or 0.0) for d, c in sides)


def _copied(rows: DataFrame, cell: tuple[Column, Column], around: int, steps: list[tuple[int, int]]) -> DataFrame:
    """A row for each step (cells north, cells east) from the row's own cell: ``_a`` and ``_b`` of the cell there, ``_own`` if it is the row's."""
    x, y = cell
    cells = F.array(*[F.struct((x + i).alias("a"), F.pmod(y + j, F.lit(around)).alias("b"), F.lit(i == j == 0).alias("own")) for i, j in steps])
    return rows.withColumn("_c", F.explode(cells)).select(*rows.columns, F.col("_c.a").alias("_a"), F.col("_c.b").alias("_b"), F.col("_c.own").alias("_own"))


def radius_join(left: DataFrame, right: DataFrame, at: tuple[str, str], to: tuple[str, str], radius_m: float, max_abs_lat: float | None = None, metric=geo.haversine_m, keys: tuple[str, ...] = (), spread: bool = True) -> DataFrame:
    """Pairs of rows at most ``radius_m`` apart and equal in ``keys``, with ``dist_m``.

    Both sides get cells as large as the radius at the highest latitude (read off the
    data, unless a bound is given); the right side is copied to the cells around its own,
    also across the date line, which makes an equi-join that Spark can hash, sort and
    split, and the exact distance decides. ``spread`` deals both sides out by cell; without
    it Spark may broadcast the right side, which only callers that know it to be small want:
    it reads a side's size off the files, not off the copies.
    """
    size = cell_size(radius_m * 1.0001, farthest_north((left, at[0]), (right, to[0])) if max_abs_lat is None else max_abs_lat)
    a, b = _cells(F.col(at[0]), F.col(at[1]), size)
    around = round(360.0 / size[1])
    l = left.withColumns({"_a": a, "_b": b})
    r = _copied(right, _cells(F.col(to[0]), F.col(to[1]), size), around, [(i, j) for i in (-1, 0, 1) for j in sorted({k % around for k in (-1, 0, 1)})]).drop("_own")
    d = l.join(r.hint("merge") if spread else r, ["_a", "_b", *keys]).drop("_a", "_b")
    return d.withColumn("dist_m", metric(F.col(at[0]), F.col(at[1]), F.col(to[0]), F.col(to[1]))).filter(F.col("dist_m") <= radius_m)


def radius_pairs(rows: DataFrame, key: str, at: tuple[str, str], radius_m: float, max_abs_lat: float | None = None, metric=geo.haversine_m, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a table's rows with different ``key``, at most ``radius_m`` apart and equal in ``keys``, both ways: a, b, dist_m.

    Like ``radius_join``, but a row is copied only to its own cell and to four of the eight
    around it, so each pair meets once, with half the copies and half the comparisons, and
    then comes out both ways; the metric must be symmetric. Both sides are dealt out by
    cell: a broadcast would take the copies through the driver and leave all pairs to the
    few tasks that read the other side.
    """
    size = cell_size(radius_m * 1.0001, farthest_north((rows, at[0])) if max_abs_lat is None else max_abs_lat)
    steps = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0)]
    if 360.0 / size[1] < 2.5:
        # With one or two columns round the globe the one to the east is also the one to the west: take them as one.
        size, steps = (size[0], 360.0), [(-1, 0), (0, 0)]
    own = rows.select(F.col(key).alias("a"), F.col(at[0]).alias("_lat"), F.col(at[1]).alias("_lon"), *keys)
    other = own.withColumnsRenamed({"a": "b", "_lat": "_blat", "_lon": "_blon"})
    x, y = _cells(F.col("_lat"), F.col("_lon"), size)
    r = _copied(other, _cells(F.col("_blat"), F.col("_blon"), size), round(360.0 / size[1]), steps)
    d = own.withColumns({"_a": x, "_b": y}).join(r.hint("merge"), ["_a", "_b", *keys])
    d = d.filter(F.when(F.col("_own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    d = d.withColumn("dist_m", metric(F.col("_lat"), F.col("_lon"), F.col("_blat"), F.col("_blon"))).filter(F.col("dist_m") <= radius_m)
    return d.select(F.inline(F.array(F.struct("a", "b", "dist_m"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "dist_m"))))


#: Half the way round the globe in metres: no two places are farther apart.
FARTHEST_M = 2.01e7
#: A right side of the nearest-neighbour join up to which Spark may broadcast it and its copies.
FEW_ROWS = 100_000


def nearest(left: DataFrame, right: DataFrame, key: str, at: tuple[str, str], to: tuple[str, str], tie: str, radius_m: float | None = None, other: Column | None = None) -> DataFrame:
    """Each left row's nearest right row (ties to the smaller ``tie``): key, tie and dist_m.

    A radius join finds it for all rows that have any neighbour in the radius; the
    rest, checkpointed, go on with four times the radius up to the whole globe, so dense
    areas never meet all pairs and no row goes without, however far its neighbour is.
    The first radius follows from the spacing of the right side. ``other`` is a
    condition that partners must meet (a row's own place is no neighbour).
    """
    north = farthest_north((left, at[0]), (right, to[0]))
    n, h, w = right.agg(F.count(F.lit(1)), F.max(to[0]) - F.min(to[0]), F.max(to[1]) - F.min(to[1])).first()
    if radius_m is None:
        radius_m = max(1.0, 2 * K.DEGREE_M * ((h or 0.0) * (w or 0.0) / max(n, 1)) ** 0.5)
    found, rest = None, left.select(key, *at)
    while True:
        near = radius_join(rest, right.select(tie, *to), at, to, min(radius_m, FARTHEST_M), north, spread=n > FEW_ROWS)
        near = near if other is None else near.filter(other)
        got = near.groupBy(key).agg(F.min(F.struct("dist_m", tie)).alias("m")).select(key, F.col(f"m.{tie}").alias(tie), F.col("m.dist_m").alias("dist_m"))
        got = checkpointed(got)
        found = got if found is None else found.unionByName(got)
        if radius_m > FARTHEST_M or n == 0:
            return found
        rest = checkpointed(rest.join(got.select(key), key, "left_anti"))
        if not rest.take(1):
            return found
        radius_m *= 4


#: Degrees of the coarsest cell of the box index; each level halves them.
COARSEST, FINEST = 512.0, 40


def _level(margin: float) -> Column:
    """The finest level whose cells are no smaller than a map widened by ``margin`` degrees (and a little more, so that rounding leaves no edge out)."""
    wide = F.greatest(F.abs(F.col("lt_lat") - F.col("rb_lat")), F.abs(F.col("lt_lon") - F.col("rb_lon"))) + 2 * margin
    return F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(COARSEST) / (wide * 1.000001 + 1e-8))))).cast("int")


def _cell(level: Column) -> Column:
    return F.lit(COARSEST) / F.pow(F.lit(2.0), level)


def _box_cells(maps: DataFrame, margin: float) -> DataFrame:
    """A row (_level, _cx, _cy) for each cell that a widened map touches: four at most."""
    d = maps.withColumn("_level", _level(margin))
    more = margin + 1e-9
    run = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - more) / _cell(F.col("_level"))), F.floor((F.greatest(a, b) + more) / _cell(F.col("_level")))))
    return d.withColumn("_cx", run("lt_lon", "rb_lon")).withColumn("_cy", run("lt_lat", "rb_lat"))


def _best_map(points: DataFrame, maps: DataFrame, levels: list[int], margin: float, most: float | None) -> DataFrame:
    """_pid, _row and ``b``, the best map within ``margin`` degrees: one that holds the point or, if ``most`` is given, one that it overflows by that much at most; null where there is none.

    A point looks its cell up on each level that has maps, ``FINEST`` + 1 at most: an equi-join.
    """
    p = points.withColumn("_l", F.explode(F.array(*[F.lit(v) for v in levels])))
    p = p.withColumns({"_x": F.floor(F.col("_lon") / _cell(F.col("_l"))), "_y": F.floor(F.col("_lat") / _cell(F.col("_l")))})
    j = p.join(_box_cells(maps, margin), (F.col("_l") == F.col("_level")) & (F.col("_x") == F.col("_cx")) & (F.col("_y") == F.col("_cy")), "left")
    m = geo.map_columns()
    px, py = geo.gps_to_px(F.col("_lat"), F.col("_lon"), m)
    j = j.withColumns({"px": px, "py": py})
    x, y, zero = F.col("px"), F.col("py"), F.lit(0.0)
    hit = geo.in_box(x, y, m["w"], m["h"])
    over = F.greatest(zero, -x) + F.greatest(zero, x - m["w"]) + F.greatest(zero, -y) + F.greatest(zero, y - m["h"])
    best = F.struct((~hit).alias("miss"), F.when(hit, 0.0).otherwise(over).alias("over"), "map_id", "px", "py", *[c for c in maps.columns if c != "map_id"])
    return j.groupBy("_pid").agg(F.first("_row").alias("_row"), F.first("_lat").alias("_lat"), F.first("_lon").alias("_lon"), F.min(F.when(F.col("_level").isNotNull() & (hit if most is None else hit | (over <= most)), best)).alias("b"))


def map_for_point(points: DataFrame, maps: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point with the first map that holds it, else the map it overflows least (in that map's pixels; ties to the smaller map_id), its pixel clamped.

    Adds map_id, px, py, in_bounds and the map's columns. Maps of any number are joined by
    cells: each lies in at most four cells of a level that fits its size. Points in no map
    look around in growing rings: a map farther than r degrees overflows by r times the
    least scale of all maps or more, so what has been found below that stands. Points
    without a position keep their row, with no map and in_bounds false; so do all where
    there are no maps.
    """
    own = points.select(F.monotonically_increasing_id().alias("_pid"), F.struct(*points.columns).alias("_row"), F.nanvl(F.col(lat).cast("double"), F.lit(None)).alias("_lat"), F.nanvl(F.col(lon).cast("double"), F.lit(None)).alias("_lon"))
    m = geo.map_columns()
    n, scale, tall, broad, levels = maps.agg(F.count(F.lit(1)), F.min(F.least(m["pplat"], m["pplon"])), F.max("lt_lat") - F.min("rb_lat"), F.max("rb_lon") - F.min("lt_lon"), F.collect_set(_level(0.0))).first()
    cols = [c for c in maps.columns if c != "map_id"]
    if not n:
        none = [F.lit(None).cast(t).alias(c) for c, t in [("map_id", maps.schema["map_id"].dataType), ("px", "double"), ("py", "double"), *[(c, maps.schema[c].dataType) for c in cols]]]
        return points.select("*", *none, F.lit(False).alias("in_bounds"))
    found = checkpointed(_best_map(own, maps, sorted(levels), 0.0, None))
    done, rest = [found.filter("b IS NOT NULL OR _lat IS NULL OR _lon IS NULL")], found.filter("b IS NULL AND _lat IS NOT NULL AND _lon IS NOT NULL").drop("b")
    ring = max(1e-6, 2 * ((tall or 0.0) * (broad or 0.0) / n) ** 0.5)
    while rest.take(1):
        levels = sorted(r[0] for r in maps.select(_level(ring)).distinct().collect())
        near = checkpointed(_best_map(rest, maps, levels, ring, ring * scale if ring <= 1000 else math.inf))
        done.append(near.filter("b IS NOT NULL"))
        rest = near.filter("b IS NULL").drop("b")
        if ring > 1000:
            break
        ring *= 4
    out = reduce(DataFrame.unionAll, [d.select("_row.*", "b.*") for d in done])
    zero = F.lit(0.0)
    clamp = lambda v, size: F.when(F.col("miss"), F.least(F.greatest(F.col(v), zero), F.col(size) - 1)).otherwise(F.col(v))
    return out.withColumns({"px": clamp("px", "w"), "py": clamp("py", "h"), "in_bounds": F.coalesce(~F.col("miss"), F.lit(False))}).drop("miss", "over")


def tile_grid(maps: DataFrame, tile: int = 1024, stride: int = 512) -> DataFrame:
    """Tiles of each map in row-major order: map_id, tile_id, x0, y0, lat, lon of the centre.

    Steps of ``stride`` and one more tile flush with the right and bottom edge; a
    map smaller than a tile is an error.
    """
    m = geo.map_columns()

    def steps(n: Column) -> Column:
        last = F.when(n >= tile, n - tile).otherwise(F.raise_error(F.lit("map smaller than a tile")).cast("double")).cast("long")
        grid = F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long"))
        return F.array_sort(F.array_distinct(F.concat(grid, F.array(last))))

    d = maps.select("*", F.posexplode(steps(m["h"])).alias("yi", "y0"), F.size(steps(m["w"])).alias("nx")).select("*", F.posexplode(steps(m["w"])).alias("xi", "x0"))
    lat, lon = geo.px_to_gps(F.col("x0") + tile / 2, F.col("y0") + tile / 2, m)
    return d.select("map_id", (F.col("yi") * F.col("nx") + F.col("xi")).cast("long").alias("tile_id"), "x0", "y0", lat.alias("lat"), lon.alias("lon"))

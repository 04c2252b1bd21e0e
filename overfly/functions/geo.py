"""Geodesic and pixel geometry as column expressions (no Python in the row path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; the square is clamped to [0, 1]."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * K.EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def map_scale(m: dict[str, Column]) -> dict[str, Column]:
    """A map's corners and size with its pixels per degree."""
    return m | {"pplat": m["h"] / (m["lt_lat"] - m["rb_lat"]), "pplon": m["w"] / (m["rb_lon"] - m["lt_lon"])}


def map_columns(prefix: str = "") -> dict[str, Column]:
    """The geometry of a map row: lt_lat, lt_lon, rb_lat, rb_lon, w, h, pplat, pplon."""
    return map_scale({k: F.col(prefix + k).cast("double") for k in ("lt_lat", "lt_lon", "rb_lat", "rb_lon", "w", "h")})


def gps_to_px(lat: Column, lon: Column, m: dict[str, Column]) -> tuple[Column, Column]:
    return (lon - m["lt_lon"]) * m["pplon"], (m["lt_lat"] - lat) * m["pplat"]


def px_to_gps(x: Column, y: Column, m: dict[str, Column]) -> tuple[Column, Column]:
    """(lat, lon)."""
    return m["lt_lat"] - y / m["pplat"], m["lt_lon"] + x / m["pplon"]


def footprint_k(flight: Column, override: Column | None = None) -> Column:
    known = F.create_map(*[F.lit(v) for kv in K.FOOTPRINT_K.items() for v in kv])
    return F.coalesce(*([override] if override is not None else []), F.try_element_at(known, flight), F.lit(K.FOOTPRINT_K_DEFAULT))


def metres_per_px(height: Column, k: Column, factor: float = K.SEARCH_FACTOR, width: int = K.CROP_W) -> Column:
    return F.lit(factor) * k * height / F.lit(float(width))


def metric_affine(m: dict[str, Column], cx: Column, cy: Column, gsd: Column, yaw: Column, w: int = K.CROP_W, h: int = K.CROP_H) -> dict[str, Column]:
    """Patch pixel to map pixel: x = a*px + b*py + tx, y = c*px + d*py + ty."""
    sx = m["pplon"] / (F.cos(F.radians((m["lt_lat"] + m["rb_lat"]) / 2)) * F.lit(K.DEGREE_M))
    sy = m["pplat"] / F.lit(K.DEGREE_M)
    co, si = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    a, b, c, d = gsd * sx * co, -gsd * sx * si, gsd * sy * si, gsd * sy * co
    return {"a": a, "b": b, "c": c, "d": d, "tx": cx - a * (w / 2) - b * (h / 2), "ty": cy - c * (w / 2) - d * (h / 2)}


def apply_affine(t: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return t["a"] * x + t["b"] * y + t["tx"], t["c"] * x + t["d"] * y + t["ty"]


def invert_affine(t: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """The patch pixel of a map pixel."""
    det = t["a"] * t["d"] - t["b"] * t["c"]
    u, v = x - t["tx"], y - t["ty"]
    return (t["d"] * u - t["b"] * v) / det, (t["a"] * v - t["c"] * u) / det


def corner_box(t: dict[str, Column], w: int = K.CROP_W, h: int = K.CROP_H) -> dict[str, Column]:
    """Least and largest map pixel of the patch's four corners."""
    pts = [apply_affine(t, lit(x), lit(y)) for x in (0, w - 1) for y in (0, h - 1)]
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return {"x0": F.least(*xs), "x1": F.greatest(*xs), "y0": F.least(*ys), "y1": F.greatest(*ys)}


def coverage(box: dict[str, Column], m: dict[str, Column]) -> Column:
    """The share of the corners' box that lies on the map; null for an empty box."""
    zero = F.lit(0.0)
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    inter = F.greatest(zero, F.least(m["w"], box["x1"]) - F.greatest(zero, box["x0"])) * F.greatest(zero, F.least(m["h"], box["y1"]) - F.greatest(zero, box["y0"]))
    return F.when(area > 0, inter / area)


def roi(box: dict[str, Column], cx: Column, cy: Column, m: dict[str, Column]) -> dict[str, Column]:
    """The map window that is read for a crop: half a diagonal and 4 pixels around the centre (half-even rounding), clamped."""
    half = F.ceil(F.hypot(box["x1"] - box["x0"], box["y1"] - box["y0"]) / 2) + 4
    x, y = F.bround(cx, 0).cast("long"), F.bround(cy, 0).cast("long")
    zero = F.lit(0).cast("long")
    return {"x0": F.greatest(zero, x - half), "y0": F.greatest(zero, y - half), "x1": F.least(m["w"].cast("long"), x + half), "y1": F.least(m["h"].cast("long"), y + half)}


def in_box(x: Column, y: Column, w, h) -> Column:
    """Half-open pixel box."""
    return (x >= 0) & (x < w) & (y >= 0) & (y < h)


def project(hm: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a 3x3 transform given row by row."""
    w = hm[6] * x + hm[7] * y + hm[8]
    return (hm[0] * x + hm[1] * y + hm[2]) / w, (hm[3] * x + hm[4] * y + hm[5]) / w


def similarity_scale(hm: list[Column]) -> Column:
    return F.sqrt(F.abs(hm[0] * hm[4] - hm[1] * hm[3]))


def similarity_rotation(hm: list[Column]) -> Column:
    return F.degrees(F.atan2(hm[3], hm[0]))


def circular_distance(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def circular_mean(c: Column) -> Column:
    """Aggregate."""
    return F.degrees(F.atan2(F.sum(F.sin(F.radians(c))), F.sum(F.cos(F.radians(c)))))


def corrected_yaw(flight: Column, yaw: Column) -> Column:
    """Yaw plus the offset of the flight's nearest leg; the first of equally near ones; unknown flights unchanged."""
    out = yaw
    for name, legs in K.YAW_LEGS.items():
        near = F.array_min(F.array(*[F.struct(circular_distance(yaw, F.lit(h)).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, (h, o) in enumerate(legs)]))
        out = F.when(flight == name, yaw + near["o"]).otherwise(out)
    return out


def metres_per_lon(lat: Column) -> Column:
    return F.lit(K.DEGREE_M) * F.cos(F.radians(lat))


def east_north(lat: Column, lon: Column, plat: Column, plon: Column) -> tuple[Column, Column]:
    return (plon - lon) * metres_per_lon(lat), (plat - lat) * F.lit(K.LATITUDE_M)


def along_cross(e: Column, n: Column, te: Column, tn: Column) -> tuple[Column, Column]:
    return e * te + n * tn, n * te - e * tn


def flat_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular metres at the middle latitude."""
    dx = (lon1 - lon2) * F.lit(K.DEGREE_M) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(dx, (lat1 - lat2) * F.lit(K.LATITUDE_M))


def shifted_gps(lat: Column, lon: Column, dx_m: Column, dy_m: Column) -> tuple[Column, Column]:
    """A position moved by metres east and north."""
    return lat + dy_m / F.lit(K.DEGREE_M), lon + dx_m / (F.lit(K.DEGREE_M) * F.cos(F.radians(lat)))


def clamp_offset(dx: Column, dy: Column, most: Column) -> tuple[Column, Column]:
    norm = F.hypot(dx, dy)
    s = F.when((most > 0) & (norm > most), most / norm).otherwise(F.lit(1.0))
    return dx * s, dy * s


def geo_homography(gx: Column, gy: Column, factor: float = K.SEARCH_FACTOR) -> list[Column]:
    """Query frame to crop: scale 1/factor, its centre onto (gx, gy)."""
    s, z = F.lit(1 / factor), F.lit(0.0)
    return [s, z, gx - s * (K.CROP_W / 2), z, s, gy - s * (K.CROP_H / 2), z, z, F.lit(1.0)]


def rescaled(hm: list[Column], sx: float, sy: float) -> list[Column]:
    """S * H * inverse(S) with S = diag(sx, sy, 1)."""
    s = [sx, sy, 1.0]
    return [hm[3 * i + j] * F.lit(s[i] / s[j]) for i in range(3) for j in range(3)]


def inverse(hm: list[Column]) -> list[Column]:
    """The inverse of a 3x3 transform given row by row (up to scale, which points do not see)."""
    at = lambda i, j: hm[3 * (i % 3) + j % 3]
    return [at(j + 1, i + 1) * at(j + 2, i + 2) - at(j + 1, i + 2) * at(j + 2, i + 1) for i in range(3) for j in range(3)]


def season(date: Column) -> Column:
    """Meteorological season of an ISO date string, cut at T; '' where it can't be read."""
    month = F.month(F.try_to_timestamp(F.split(date, "T")[0], F.lit("yyyy-MM-dd")))
    names = F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isNotNull(), "autumn")
    return F.coalesce(names, F.lit(""))


def nearest_of(value: Column, choices: list[float]) -> Column:
    """The choice nearest to the value, the first of equally near ones."""
    return F.array_min(F.array(*[F.struct(F.abs(value - c).alias("d"), F.lit(i).alias("i"), F.lit(float(c)).alias("c")) for i, c in enumerate(choices)]))["c"]


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)

"""Order-dependent and robust-fit operators that need imperative code: grouped Arrow/pandas functions.

Groups are single image pairs or flights, which are bounded by what one image or
flight holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import clamp_offset, in_box, project
from . import consensus
from .store import checkpointed, ship


#: Correspondences of a pair that one task may decide on.
PAIR_ROWS = 1 << 17


def greedy_one_to_one(d: DataFrame, key: str = "pair", cell: float = 8.0, order: tuple[str, ...] = ("k1", "k2", "k3"), limit: int = PAIR_ROWS) -> DataFrame:
    """Keep a correspondence if neither its source nor its target cell is taken, by falling confidence (missing last).

    Ties in confidence go by ``order``. Pairs of up to ``limit`` rows are decided row by row
    in a grouped function. A larger pair is thinned in rounds first: rows that lead in
    both their cells stay, as nothing earlier can take these, and what they block goes;
    cells are joined on, so a pair spreads over tasks. Either way gives the same rows.
    """
    large = d.groupBy(key).count().filter(F.col("count") > limit).select(F.col(key).alias("_large"))
    if not large.take(1):
        return _greedy(d, key, cell, order)
    mine = F.col(key).eqNullSafe(F.col("_large"))
    place = lambda x, y: F.struct(F.floor(F.col(x) / cell), F.floor(F.col(y) / cell))
    first = F.struct(F.coalesce(-F.col("conf"), F.lit(float("inf"))), *order, F.monotonically_increasing_id().alias("_id"))
    open_ = checkpointed(d.join(large, mine, "left_semi").withColumns({"_s": place("x0", "y0"), "_t": place("x1", "y1"), "_o": first}))
    kept = []
    while open_.groupBy(key).count().filter(F.col("count") > limit).take(1):
        best = {c: open_.groupBy(F.col(key).alias(f"_k{c}"), F.col(c).alias(f"_c{c}")).agg(F.min("_o").alias(f"_m{c}")) for c in ("_s", "_t")}
        at = lambda c: F.col(key).eqNullSafe(F.col(f"_k{c}")) & (F.col(c) == F.col(f"_c{c}"))
        lead = checkpointed(open_.join(best["_s"], at("_s")).join(best["_t"], at("_t")).filter((F.col("_o") == F.col("_m_s")) & (F.col("_o") == F.col("_m_t"))).select(*d.columns, "_s", "_t"))
        kept.append(lead)
        taken = {c: lead.select(F.col(key).alias(f"_k{c}"), F.col(c).alias(f"_c{c}")) for c in ("_s", "_t")}
        open_ = checkpointed(open_.join(taken["_s"], at("_s"), "left_anti").join(taken["_t"], at("_t"), "left_anti"))
    out = _greedy(d.join(large, mine, "left_anti"), key, cell, order).unionByName(_greedy(open_.select(*d.columns), key, cell, order))
    for k in kept:
        out = out.unionByName(k.select(*d.columns))
    return out


def _greedy(d: DataFrame, key: str, cell: float, order: tuple[str, ...]) -> DataFrame:
    def run(pdf):
        pdf = pdf.sort_values(["conf", *order], ascending=[False] + [True] * len(order), kind="stable")
        a = list(zip((pdf.x0 // cell).astype(int), (pdf.y0 // cell).astype(int)))
        b = list(zip((pdf.x1 // cell).astype(int), (pdf.y1 // cell).astype(int)))
        left, right, keep = set(), set(), []
        for i, (u, v) in enumerate(zip(a, b)):
            if u not in left and v not in right:
                left.add(u)
                right.add(v)
                keep.append(i)
        return pdf.iloc[keep]

    return d.groupBy(key).applyInPandas(run, d.schema)


def weighted_similarity(d: DataFrame, keys: list[str], w: Column) -> DataFrame:
    """Closed-form weighted 4-parameter similarity (a, b, tx, ty): x' = a*x - b*y + tx, y' = b*x + a*y + ty. Pure aggregates."""
    x, y, u, v = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    s = {"w": w, "x": w * x, "y": w * y, "u": w * u, "v": w * v, "xx": w * (x * x + y * y), "xu": w * (x * u + y * v), "xv": w * (x * v - y * u)}
    g = d.groupBy(*keys).agg(*[F.sum(c).alias(f"s{k}") for k, c in s.items()])
    c = {k: F.col(f"s{k}") for k in s}
    den = c["xx"] - (c["x"] * c["x"] + c["y"] * c["y"]) / c["w"]
    a = F.try_divide(c["xu"] - (c["x"] * c["u"] + c["y"] * c["v"]) / c["w"], den)
    b = F.try_divide(c["xv"] - (c["x"] * c["v"] - c["y"] * c["u"]) / c["w"], den)
    g = g.withColumns({"a": a, "b": b})
    tx, ty = (c["u"] - F.col("a") * c["x"] + F.col("b") * c["y"]) / c["w"], (c["v"] - F.col("b") * c["x"] - F.col("a") * c["y"]) / c["w"]
    return g.select(*keys, "a", "b", tx.alias("tx"), ty.alias("ty"))


def residual(m: list[Column]) -> Column:
    """A correspondence's distance from where the similarity (a, b, tx, ty) puts it."""
    a, b, tx, ty = m
    x, y = F.col("x0"), F.col("y0")
    return F.hypot(a * x - b * y + tx - F.col("x1"), b * x + a * y + ty - F.col("y1"))


def agreement(d: DataFrame, models: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, n, inliers and their mean residual: how many of a group's correspondences a given similarity (a, b, tx, ty) explains."""
    r = residual([F.col(c) for c in ("a", "b", "tx", "ty")])
    x = d.join(models, keys).select(*keys, r.alias("r"))
    inside = F.col("r") < threshold
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inliers"), F.avg(F.when(inside, F.col("r"))).alias("mean_r"))


def _by_confidence(pdf, order):
    """A pair's points in falling confidence, ties by ``order``, missing confidence last; the same in any partitioning."""
    return pdf.sort_values(["conf", *order], ascending=[False] + [True] * len(order), kind="stable").reset_index(drop=True)


def ransac_similarity(d: DataFrame, key: str = "pair", threshold: float = 5.0, most: int = consensus.MOST, confidence: float = consensus.CONFIDENCE, least: int = 4, order: tuple[str, ...] = ("k1", "k2", "k3")) -> DataFrame:
    """A similarity per pair by ``consensus.similarity``: key, n, inliers, a, b, tx, ty (null under ``least`` points or without consensus).

    The seed is the pair's key and rows are sorted first, so partitioning cannot change
    the result. Points with a missing coordinate do not count. Groups are single image pairs.
    """
    ship(d.sparkSession)
    points = ["x0", "y0", "x1", "y1"]

    def run(pdf):
        pdf = _by_confidence(pdf, order)
        k, n = int(pdf[key].iloc[0]), len(pdf)
        row = {key: k, "n": n, "inliers": 0, "a": None, "b": None, "tx": None, "ty": None}
        if n >= least:
            xy = pdf[points].to_numpy("float64")
            m, inl, _ = consensus.similarity(xy[:, :2], xy[:, 2:], threshold, abs(k), most, confidence)
            if m is not None:
                row |= {"inliers": int(inl.sum()), **dict(zip(("a", "b", "tx", "ty"), m.tolist()))}
        return pd.DataFrame([row])

    whole = d.select(key, *points, "conf", *order).dropna(subset=[key, *points])
    return whole.groupBy(key).applyInPandas(run, f"{key} long, n int, inliers int, a double, b double, tx double, ty double")


def ransac_homography(d: DataFrame, key: str = "pair", threshold: float = 5.0, samples: int = consensus.MOST, confidence: float = consensus.CONFIDENCE, least: int = 4, most: int | None = None, order: tuple[str, ...] = ("k1", "k2", "k3")) -> DataFrame:
    """The correspondences that agree with a pair's homography (``consensus.homography``), with that transform as ``h`` (row by row, h[8] = 1).

    Seeded by the pair's key over rows in falling confidence (ties by ``order``), so
    partitioning cannot change the result. Pairs with fewer than ``least`` points, or
    without consensus, give no rows; points with a missing coordinate do not count.
    ``most`` keeps the most confident inliers. Groups are single image pairs.
    """
    ship(d.sparkSession)
    points = ["x0", "y0", "x1", "y1"]
    schema = ", ".join(f"`{k}` {t}" for k, t in d.dtypes) + ", h array<double>"

    def run(pdf):
        pdf = _by_confidence(pdf, order)
        if len(pdf) < least:
            return pdf.iloc[:0].assign(h=None)
        xy = pdf[points].to_numpy("float64")
        h, inl, _ = consensus.homography(xy[:, :2], xy[:, 2:], threshold, abs(int(pdf[key].iloc[0])), samples, confidence)
        if h is None:
            return pdf.iloc[:0].assign(h=None)
        out = pdf[inl].head(most) if most is not None else pdf[inl]
        return out.assign(h=[h.tolist()] * len(out))

    return d.dropna(subset=[key, *points]).groupBy(key).applyInPandas(run, schema)


def most_confident(d: DataFrame, most: int, key: str = "pair", order: tuple[str, ...] = ("k1", "k2", "k3")) -> DataFrame:
    """The ``most`` rows of highest confidence of each pair, ties by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc("conf"), *order)
    return d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def looped_back(d: DataFrame, hm: list[Column], back: list[Column], width: int, height: int, scale: int, real: tuple[int, int]) -> DataFrame:
    """A row for each coarse cell of each pair of images whose grid point returns: the rows' columns, i and j.

    Cell i's point goes through ``hm`` to the nearest cell j of the other grid (half-even;
    outside the real frame: cell 0), and j's through ``back``; i is kept if it comes back,
    lies in the real frame and is not cell 0. Each side is a function of the cell alone, so
    no join is needed, and all of it stays in generated code. Transforms are made once a
    row, before cells are, and each step once a cell: generators keep the optimizer from
    writing a step out again wherever its result is used.
    """
    w, h = width // scale, height // scale
    rw, rh = real[0] // scale, real[1] // scale

    def to(x: DataFrame, m: str, cell: str, name: str) -> DataFrame:
        c = F.col(cell)
        px, py = project([F.col(f"{m}{k}") for k in range(9)], F.pmod(c, F.lit(w)) * float(scale), F.floor(c / w) * float(scale))
        x = x.select("*", F.inline(F.array(F.struct(px.alias("_px"), py.alias("_py")))))
        x = x.select("*", F.inline(F.array(F.struct(F.bround(F.col("_px") / float(scale), 0).alias("_cx"), F.bround(F.col("_py") / float(scale), 0).alias("_cy")))))
        inside = in_box(F.col("_cx"), F.col("_cy"), rw, rh)
        found = F.when(inside, F.col("_cx") + F.col("_cy") * w).otherwise(F.lit(0.0)).cast("int")
        return x.select("*", F.explode(F.array(found)).alias(name)).drop("_px", "_py", "_cx", "_cy")

    i = F.col("i")
    x = d.select("*", *[c.alias(f"_h{k}") for k, c in enumerate(hm)], *[c.alias(f"_b{k}") for k, c in enumerate(back)])
    x = x.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(w * h - 1))))
    x = to(x.filter((F.pmod(i, F.lit(w)) < rw) & (F.floor(i / w) < rh)), "_h", "i", "j")
    x = to(x, "_b", "j", "_i")
    return x.filter(F.col("_i") == i).select(*d.columns, "i", "j")


def offset_mode(flight: Column, name: Column, mode: str, share: int) -> Column:
    """``true`` or ``jitter`` for each row; ``mix`` takes true positions for ``share`` percent of the rows, by the CRC-32 of their key."""
    if mode != "mix":
        return F.lit(mode)
    return F.when(F.crc32(F.concat_ws("/", F.lit("mix"), flight, name)) % 100 < share, "true").otherwise("jitter")


def crop_offsets(d: DataFrame, mode: str, share: int, sigma: float, metres_per_px: Column, margin_px: float, side_px: float) -> DataFrame:
    """Add mode, dx_m and dy_m: no offset on true positions, else the row's seeded normal offset, shortened so that the truth stays ``margin_px`` inside the crop."""
    d = gaussian_offsets(d, F.concat_ws("/", "flight", "filename"), sigma).withColumn("mode", offset_mode(F.col("flight"), F.col("filename"), mode, share))
    u, v = clamp_offset(F.col("dx_m"), F.col("dy_m"), metres_per_px * (side_px / 2 - margin_px))
    true = F.col("mode") == "true"
    return d.withColumn("_u", F.when(true, 0.0).otherwise(u)).withColumn("_v", F.when(true, 0.0).otherwise(v)).drop("dx_m", "dy_m").withColumnsRenamed({"_u": "dx_m", "_v": "dy_m"})


def leg_clusters(d: DataFrame, reach: float = 45.0, least: int = 3) -> DataFrame:
    """Flight legs: headings in order join the first cluster whose circular mean is nearer than ``reach``; clusters of ``least`` members stay."""

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("seq")
        legs = []
        for h, r in zip(pdf.heading, pdf.residual):
            z = np.exp(1j * np.radians(h))
            for leg in legs:
                mean = np.degrees(np.angle(leg["z"]))
                if abs((h - mean + 180) % 360 - 180) < reach:
                    leg["z"] += z
                    leg["r"].append(r)
                    break
            else:
                legs.append({"z": z, "r": [r]})
        rows = [(pdf.flight.iloc[0], i, round(float(np.degrees(np.angle(x["z"]))), 1), round(float(np.median(x["r"])), 1), len(x["r"])) for i, x in enumerate(legs) if len(x["r"]) >= least]
        return pd.DataFrame(rows, columns=["flight", "leg", "heading", "offset", "n"])

    return d.groupBy("flight").applyInPandas(run, "flight string, leg int, heading double, offset double, n int")


def spread_choice(d: DataFrame, want: int, key: str = "flight") -> DataFrame:
    """Midpoints of ``want`` equal stretches, each moved outward (the earlier of equally near frames first) to an accepted frame that is still free.

    Frames come out in their own order; ``slot`` numbers them.
    """

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("seq").reset_index(drop=True)
        n = len(pdf)
        open_ = pdf["accepted"].to_numpy(dtype=bool, na_value=False).copy()
        picked = []
        for mid in (int((j + 0.5) * n / want) for j in range(want)):
            free = np.flatnonzero(open_)
            if len(free):
                # argmin takes the first of equal distances: the earlier frame.
                hit = int(free[np.abs(free - mid).argmin()])
                open_[hit] = False
                picked.append(hit)
        return pdf.iloc[sorted(picked)][[key, "seq"]].assign(slot=range(len(picked)))

    return d.groupBy(key).applyInPandas(run, f"{key} string, seq long, slot int")


def gaussian_offsets(d: DataFrame, key: Column, sigma: float) -> DataFrame:
    """Add dx_m, dy_m: two normal numbers of a generator seeded by the CRC-32 of the row's key, the same in any partitioning."""
    @F.pandas_udf("struct<dx_m:double,dy_m:double>")
    def draw(seed: pd.Series) -> pd.DataFrame:
        import numpy as np

        return pd.DataFrame([np.random.default_rng(int(s)).normal(0.0, sigma, 2) for s in seed], columns=["dx_m", "dy_m"])

    return d.withColumn("_o", draw(F.crc32(key))).select("*", "_o.dx_m", "_o.dy_m").drop("_o")

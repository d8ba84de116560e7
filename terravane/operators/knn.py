"""Nearest-neighbour joins J05-J07, J11 and the epsilon join J12.

Cells and targets are laid on one lon/lat lattice, and the pairs of a cell's bin and the target bins that can hold its
nearest target are found from coarse to fine: each level joins the children of the pairs that are left and drops a
target bin that is farther than another one can at most be. So a bin meets a handful of bins, whatever the number of
targets, by equi-joins only; no side has to be small. Cells then meet the targets of their bin's candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import geo
from terravane.operators.components import connected_components
from terravane.runtime import materialize

SHIFT = 3  # a level's bins are 2**SHIFT times as wide as those of the one below


def _distances(points_only: bool) -> tuple[Column, Column]:
    lon, lat = F.col("lon"), F.col("lat")
    if points_only:
        return geo.planar_deg(lon, lat, F.col("x1"), F.col("y1")), geo.haversine_km(lon, lat, F.col("x1"), F.col("y1"))
    return geo.segment_distance(lon, lat, *(F.col(c) for c in ("x1", "y1", "x2", "y2")))


def _targets(targets: DataFrame) -> tuple[DataFrame, bool]:
    """(target_id, x1, y1, x2, y2[, grp]); points come as lon, lat."""
    if "x1" in targets.columns:
        return targets, False
    return targets.withColumnsRenamed({"lon": "x1", "lat": "y1"}).withColumns({"x2": F.col("x1"), "y2": F.col("y1")}), True


def _bin(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _segment_bins(targets: DataFrame, size: float, grow: float = 0.0) -> DataFrame:
    """``targets`` with (bx, by) of every bin within ``grow`` of the segment: column by column, the rows it passes there."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    slack = grow + 1e-9
    spread = lambda lo, hi: F.explode(F.sequence(_bin(lo - slack, size), _bin(hi + slack, size)))
    left, right = F.least(x1, x2), F.greatest(x1, x2)
    rows = targets.withColumn("bx", spread(left, right))
    inside = lambda x: F.greatest(left, F.least(right, x))
    y_at = lambda x: y1 + (inside(x) - x1) / F.when(x1 == x2, None).otherwise(x2 - x1) * (y2 - y1)
    a, b = F.coalesce(y_at(F.col("bx") * size - slack), y1), F.coalesce(y_at((F.col("bx") + 1) * size + slack), y2)
    return rows.withColumn("by", spread(F.least(a, b), F.greatest(a, b)))


def _best(pairs: DataFrame, points: bool, by: list[str]) -> DataFrame:
    deg, km = _distances(points)
    s = F.struct(deg.alias("deg"), km.alias("km"), F.col("target_id"))
    return pairs.groupBy(*by).agg(F.min(s).alias("best"))


def _bin_size(targets: DataFrame) -> float:
    """Bins of about two targets each, from their count and extent."""
    r = targets.agg(F.count("*").alias("n"), *(f(F.col(c)).alias(f"{c}{k}") for c in ("x1", "y1") for k, f in enumerate((F.min, F.max)))).first()
    if not r.n:
        return 1.0
    return min(4.0, max(0.02, 1.5 * (max(r.x11 - r.x10, 0.02) * max(r.y11 - r.y10, 0.02) / r.n) ** 0.5))


def nearest(cells: DataFrame, targets: DataFrame, bin_deg: float | None = None, groups: bool = False) -> DataFrame:
    """(cell_id[, grp], best{deg, km, target_id}): the nearest target of each cell; with ``groups`` a row for each group
    of the cell's candidates, the nearest group and the next one (if there is one) always among them.

    Cells are (cell_id, lon, lat). Order is by planar degrees, then km, then id; no row for an empty target table.
    """
    targets, points = _targets(targets)
    size = bin_deg or _bin_size(targets)
    binned = cells.select("cell_id", "lon", "lat", _bin(F.col("lon"), size).alias("bx"), _bin(F.col("lat"), size).alias("by"))
    pairs = binned.join(_candidates(binned, targets, size, groups), ["bx", "by"])
    return _best(pairs, points, ["cell_id", "grp"] if groups else ["cell_id"])


def _pruned(pairs: DataFrame, by: list[str], low: Column, high: Column, groups: bool) -> DataFrame:
    """Pairs whose least distance is within the greatest distance of the best one (with groups: of the best one of a second group)."""
    w, pairs = Window.partitionBy(*by), pairs.withColumn("_high", high)
    if not groups:
        pairs = pairs.withColumn("_reach", F.min("_high").over(w))
    else:
        pairs = pairs.withColumn("_first", F.min(F.struct("_high", "grp")).over(w))
        other = F.when(~F.col("grp").eqNullSafe(F.col("_first.grp")), F.col("_high"))
        pairs = pairs.withColumn("_reach", F.coalesce(F.min(other).over(w), F.col("_first._high"))).drop("_first")
    return pairs.filter(low <= F.col("_reach") * (1 + 1e-9) + 1e-9).drop("_high", "_reach")


def _candidates(cells: DataFrame, targets: DataFrame, size: float, groups: bool) -> DataFrame:
    """(bx, by, target...): for each bin that holds cells, the targets that can be first (or first of the second group)."""
    laid = _segment_bins(targets, size).withColumnsRenamed({"bx": "tx", "by": "ty"})
    own = ["grp"] if groups else []
    # written, as each level reads them; their sizes are then known to the planner
    at = materialize(cells.select("bx", "by").distinct(), "bins")
    to = materialize(laid.select("tx", "ty", *own).distinct(), "bins")
    levels = 0
    while size * (1 << SHIFT * levels) < 180:
        levels += 1
    coarse = lambda df, names, k, *keep: df.select(*(F.shiftright(c, SHIFT * k).alias(c) for c in names), *keep).distinct()
    # at the top the whole world has a dozen bins
    pairs = coarse(at, ("bx", "by"), levels).withColumn("one", F.lit(1)).join(coarse(to, ("tx", "ty"), levels, *own).withColumn("one", F.lit(1)), "one").drop("one")
    for k in range(levels - 1, -1, -1):
        up = lambda names: [F.shiftright(c, SHIFT).alias(f"{c}_up") for c in names]
        pairs = pairs.withColumnsRenamed({c: f"{c}_up" for c in ("bx", "by", "tx", "ty")})
        fine_at = coarse(at, ("bx", "by"), k) if k else at
        fine_to = coarse(to, ("tx", "ty"), k, *own) if k else to
        fine_to = fine_to.select(*up(("tx", "ty")), "tx", "ty", *(F.col(g).alias("grp_to") for g in own))
        met = pairs.join(fine_at.select("*", *up(("bx", "by"))), ["bx_up", "by_up"])
        met = met.join(fine_to, ["tx_up", "ty_up"])
        if groups:
            met = met.filter(F.col("grp").eqNullSafe(F.col("grp_to")))
        met = met.select("bx", "by", "tx", "ty", *own)
        side = size * (1 << SHIFT * k)
        dx, dy = F.abs(F.col("bx") - F.col("tx")), F.abs(F.col("by") - F.col("ty"))
        gap = lambda d: F.greatest(d - 1, F.lit(0))
        low, high = F.sqrt(gap(dx) * gap(dx) + gap(dy) * gap(dy)) * side, F.sqrt((dx + 1) * (dx + 1) + (dy + 1) * (dy + 1)) * side
        pairs = _pruned(met, ["bx", "by"], low, high, groups)
    met = pairs.withColumnsRenamed({g: "grp_at" for g in own}).join(laid, ["tx", "ty"])
    if groups:
        met = met.filter(F.col("grp").eqNullSafe(F.col("grp_at")))
    met = met.select("bx", "by", *targets.columns)
    # a point lies within half a diagonal of its bin's centre
    away = geo.segment_distance(*((F.col(c) + 0.5) * size for c in ("bx", "by")), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))[0]
    half = size * 0.5**0.5
    met = met.withColumn("_away", away)
    return _pruned(met, ["bx", "by"], F.col("_away") - half, F.col("_away") + half, groups).drop("_away").distinct()


def nearest_capped(cells: DataFrame, targets: DataFrame, name: str, cap_km: float | None) -> DataFrame:
    """Every cell with ``name``, the km to its nearest target, capped; NULL if there is no target."""
    km = F.col("best.km") if cap_km is None else F.least(F.col("best.km"), F.lit(cap_km))
    found = nearest(cells, targets).select("cell_id", km.alias(name))
    return cells.join(found, "cell_id", "left")


def nearest_two_groups(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(cell_id, line_id, km, other_id, other_km): nearest line, and nearest of another group (NULL is a group)."""
    found = nearest(cells, lines, groups=True)
    order = Window.partitionBy("cell_id").orderBy("best")
    ranked = found.withColumn("k", F.row_number().over(order)).filter("k <= 2")
    pick = lambda k, f: F.max(F.when(F.col("k") == k, F.col(f"best.{f}")))
    return ranked.groupBy("cell_id").agg(
        pick(1, "target_id").alias("line_id"), pick(1, "km").alias("km"), pick(2, "target_id").alias("other_id"), pick(2, "km").alias("other_km")
    )


def within_nearest(left: DataFrame, right: DataFrame, km: float = 1.0, box_deg: float = 0.009) -> DataFrame:
    """(left_id, right_id, km): for each left point its nearest right point in the box and within km; ties by id."""
    a = left.select("left_id", "lon", "lat").withColumn("bx", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _bin(F.col("lon"), box_deg) + d)))
    a = a.withColumn("by", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _bin(F.col("lat"), box_deg) + d)))
    b = right.select("right_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    b = b.withColumn("bx", _bin(F.col("x"), box_deg)).withColumn("by", _bin(F.col("y"), box_deg))
    dist = geo.haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    near = a.join(b, ["bx", "by"]).filter((F.abs(F.col("lon") - F.col("x")) <= box_deg) & (F.abs(F.col("lat") - F.col("y")) <= box_deg))
    near = near.withColumn("km", dist).filter(F.col("km") <= km)
    best = near.groupBy("left_id").agg(F.min(F.struct("km", "right_id")).alias("m"))
    return best.select("left_id", "m.right_id", "m.km")


def _within(eps: float) -> Column:
    """Whether the planar distance of segments (x1, y1, x2, y2) and (x1_b, ...) is at most eps."""
    seg, other = [F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"{c}_b") for c in ("x1", "y1", "x2", "y2")]
    ends = [
        geo.segment_distance(seg[0], seg[1], *other)[0],
        geo.segment_distance(seg[2], seg[3], *other)[0],
        geo.segment_distance(other[0], other[1], *seg)[0],
        geo.segment_distance(other[2], other[3], *seg)[0],
    ]

    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    a, b, c, d = seg[:2], seg[2:], other[:2], other[2:]
    cross = (side(a, b, c) * side(a, b, d) < 0) & (side(c, d, a) * side(c, d, b) < 0)
    return F.when(cross, 0.0).otherwise(F.least(*ends)) <= eps


def within_epsilon(points: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a < b: segments (id, x1, y1, x2, y2) whose planar distance is at most eps."""
    size = max(eps, 1e-9) * 4
    names = {c: f"{c}_b" for c in ("id", "x1", "y1", "x2", "y2")}
    plain = _segment_bins(points, size).withColumnsRenamed(names)
    pairs = _segment_bins(points, size, eps).join(plain, ["bx", "by"]).filter("id < id_b")
    return pairs.filter(_within(eps)).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def epsilon_clusters(points: DataFrame, eps: float) -> DataFrame:
    """(id, cluster): the components of the segments (id, x1, y1, x2, y2) whose planar distance is at most eps, each
    named by its smallest id. Segments without finite coordinates are in none.

    Ends in one small bin, whose diagonal is less than eps, need no distance: they link to the bin's head, in two grids
    half a bin apart. Only segments that are then still of different clusters are compared, and only in bins that
    several clusters reach. So a dense cluster costs rows near its size, not its pairs.
    """
    ends = ("x1", "y1", "x2", "y2")
    points = points.select("id", *ends).filter(F.col("id").isNotNull())
    for c in ends:
        points = points.filter(F.abs(c) < float("inf"))
    tagged = points.withColumn("c", F.col("id"))

    def joined(links: DataFrame) -> DataFrame:
        comp = materialize(connected_components(links), "components").toDF("c", "_to")
        return materialize(tagged.join(comp, "c", "left").select("id", *ends, F.coalesce("_to", "c").alias("c")), "tagged")

    for shift in (0.0, 0.5) if eps >= 1e-6 else ():
        side = 0.7 * eps  # a diagonal of 0.99 eps
        at = lambda x, y: F.struct(*(F.floor(F.col(k) / side + shift).alias(n) for k, n in ((x, "x"), (y, "y"))))
        laid = tagged.select("c", F.explode(F.array(at("x1", "y1"), at("x2", "y2"))).alias("bin")).distinct()
        heads = laid.groupBy("bin").agg(F.min("c").alias("head"))
        tagged = joined(laid.join(heads, "bin").filter("c <> head").select(F.col("c").alias("a"), F.col("head").alias("b")).distinct())
    size = max(eps, 1e-9) * 4
    near = _segment_bins(tagged, size, eps)
    # a bin within one cluster links nothing new
    live = materialize(near.groupBy("bx", "by").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("bx", "by"), "bins")
    plain = _segment_bins(tagged, size).join(live, ["bx", "by"], "left_semi").withColumnsRenamed({c: f"{c}_b" for c in ("id", "c", *ends)})
    pairs = near.join(live, ["bx", "by"], "left_semi").join(plain, ["bx", "by"]).filter("c < c_b")
    tagged = joined(pairs.filter(_within(eps)).select(F.col("c").alias("a"), F.col("c_b").alias("b")).distinct())
    return tagged.select("id", F.col("c").alias("cluster")).distinct()

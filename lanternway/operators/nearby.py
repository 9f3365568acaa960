"""Points near other points, and the regions that contain them, as dual-tree joins.

Near: the upper levels of the tree are cubes of a grid on the sphere's 3-D chord space (no seam at the
antimeridian or the poles). Cubes that cannot hold a partner never meet; each task gets one cube with the
few points just outside it and runs a dual-tree descent there. Crowded cubes are cut into smaller ones, and
what cannot be cut into blocks that meet pairwise.

Inside: the regions' boxes make one tree, which every task gets as long as it is of a checked size, and each batch of
points makes another; pairs of nodes are discarded, accepted with all their points and regions, or opened. More regions
than that are cut into quadtree cells, which points meet by an equi-join: cells wholly inside a region
accept, those on its border are refined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternway.functions.geo import EARTH_RADIUS_M, geohash_centre
from lanternway.runtime import Scratch

#: Edge lengths in metres of the cubes, coarse to fine.
CUBES = (4096.0, 512.0, 64.0)
#: Points a cube may hold before it is cut further.
CROWD = 50_000
LEAF = 16
#: Pairs gathered before they leave a task.
GIVEN_AT_ONCE = 200_000


def usable_position(lat: Column, lon: Column) -> Column:
    """Both present, finite, in range and not both exactly zero."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(ok & ~((lat == 0) & (lon == 0)), F.lit(False))


def haversine(lat_a, lon_a, lat_b, lon_b) -> np.ndarray:
    """Great-circle metres between arrays of degrees."""
    p, q = np.radians(lat_a), np.radians(lat_b)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon_b - lon_a) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def chord_space(lat, lon) -> np.ndarray:
    """Metres in three dimensions of points on the sphere."""
    p, q = np.radians(lat), np.radians(lon)
    return EARTH_RADIUS_M * np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)


class BoxTree:
    """A k-d tree as arrays: each node's slice of the ordered points and its bounding box."""

    def __init__(self, xyz: np.ndarray, leaf: int = LEAF):
        n = len(xyz)
        order = np.arange(n)
        begin, end, left, low, high = [], [], [], [], []
        todo = [(0, n)] if n else []
        at = 0
        while at < len(todo):
            b, e = todo[at]
            at += 1
            part = xyz[order[b:e]]
            lo, hi = part.min(axis=0), part.max(axis=0)
            begin.append(b), end.append(e), low.append(lo), high.append(hi)
            if e - b > leaf and (hi > lo).any():
                axis, mid = int(np.argmax(hi - lo)), (e - b) // 2
                order[b:e] = order[b:e][np.argpartition(part[:, axis], mid)]
                left.append(len(todo))
                todo += [(b, b + mid), (b + mid, e)]
            else:
                left.append(-1)
        self.order = order
        self.begin, self.end, self.left = (np.array(x, np.int64) for x in (begin, end, left))
        self.low, self.high = np.array(low).reshape(-1, xyz.shape[1]), np.array(high).reshape(-1, xyz.shape[1])


def dual_tree_pairs(a: BoxTree, b: BoxTree, reach: float):
    """Chunks (i, j, certain) of points of a and b that may lie within ``reach``.

    Node pairs are compared level by level: boxes too far apart are discarded, boxes wholly within reach
    are accepted with all their points, the larger of an uncertain pair is opened, and pairs of leaves
    come out as uncertain.
    """
    if not len(a.begin) or not len(b.begin):
        return
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        gap = np.maximum(0.0, np.maximum(a.low[p] - b.high[q], b.low[q] - a.high[p]))
        near = (gap * gap).sum(axis=1) <= reach * reach
        p, q = p[near], q[near]
        far = np.maximum(a.high[p] - b.low[q], b.high[q] - a.low[p])
        certain = (far * far).sum(axis=1) <= (reach * 0.999) ** 2
        ends = ~certain & (a.left[p] < 0) & (b.left[q] < 0)
        for chosen, sure in ((certain, True), (ends, False)):
            yield from _expand(a, b, p[chosen], q[chosen], sure)
        rest = ~certain & ~ends
        p, q = p[rest], q[rest]
        size_a, size_b = a.end[p] - a.begin[p], b.end[q] - b.begin[q]
        open_a = (a.left[p] >= 0) & ((b.left[q] < 0) | (size_a >= size_b))
        pa, qa, pb, qb = p[open_a], q[open_a], p[~open_a], q[~open_a]
        p = np.concatenate([a.left[pa], a.left[pa] + 1, pb, pb])
        q = np.concatenate([qa, qa, b.left[qb], b.left[qb] + 1])


def _expand(a: BoxTree, b: BoxTree, p: np.ndarray, q: np.ndarray, sure: bool, chunk: int = 1_000_000):
    """All point pairs of node pairs, at most about ``chunk`` at a time."""
    wide = b.end[q] - b.begin[q]
    rows = a.end[p] - a.begin[p]
    # one entry for each (point of a, node of b)
    for s in range(0, len(p), 65536):
        ps, qs, rs = p[s : s + 65536], q[s : s + 65536], rows[s : s + 65536]
        point = np.repeat(a.begin[ps], rs) + _ramp(rs)
        node, w = np.repeat(qs, rs), np.repeat(wide[s : s + 65536], rs)
        cuts = np.searchsorted(np.cumsum(w), np.arange(chunk, int(w.sum()) + chunk, chunk), "left") + 1
        for x, y in zip(np.r_[0, cuts[:-1]], cuts):
            i = np.repeat(a.order[point[x:y]], w[x:y])
            j = b.order[np.repeat(b.begin[node[x:y]], w[x:y]) + _ramp(w[x:y])]
            if len(i):
                yield i, j, sure


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _cubes(xyz: list[Column], edge: Column, reach: float) -> Column:
    """The cubes of ``edge`` metres a point or its reach touches: one, or up to eight near a border."""
    span = [F.array_distinct(F.array(F.floor((x - reach) / edge), F.floor((x + reach) / edge))) for x in xyz]
    pick = lambda i, j, k: F.struct(i.alias("i"), j.alias("j"), k.alias("k"))
    return F.flatten(F.transform(span[0], lambda i: F.flatten(F.transform(span[1], lambda j: F.transform(span[2], lambda k: pick(i, j, k))))))


def near_pairs(points: DataFrame, metres: float, crowd: int = CROWD) -> DataFrame:
    """Pairs of different ids at most ``metres`` apart on the great circle, smaller id first.

    points: id BIGINT, lat DOUBLE, lon DOUBLE. Null ids and unusable positions have no neighbours;
    an id given at several positions pairs by any of them; equal positions are 0 m apart; an empty
    table gives no pairs; other columns are ignored. Result: distinct (left_id, right_id).
    """
    spark = points.sparkSession
    reach = 2 * EARTH_RADIUS_M * np.sin(metres / (2 * EARTH_RADIUS_M)) + 1e-6
    edges = [c for c in CUBES if c > 4 * reach] or [8 * reach]
    la, lo = F.radians("lat"), F.radians("lon")
    p = (
        points.where(F.col("id").isNotNull() & usable_position(F.col("lat"), F.col("lon")))
        .select("id", "lat", "lon")
        .distinct()
        .select("id", "lat", "lon", (F.cos(la) * F.cos(lo) * EARTH_RADIUS_M).alias("x"), (F.cos(la) * F.sin(lo) * EARTH_RADIUS_M).alias("y"), (F.sin(la) * EARTH_RADIUS_M).alias("z"))
    )
    p = Scratch(spark, "near").keep(p)  # read once for counting and once for joining
    xyz = [F.col(c) for c in "xyz"]
    cell = lambda e: F.struct(*[F.floor(c / e).alias(n) for c, n in zip(xyz, "ijk")])
    # Crowded cubes are few (at most rows / crowd); each level is counted only inside crowded ones of the last.
    tasks = None
    current = p.select("id", "lat", "lon", "x", "y", "z", F.lit(0).alias("level"), F.explode(_cubes(xyz, F.lit(edges[0]), reach)).alias("cube"))
    for k, edge in enumerate(edges):
        counts = current.groupBy("cube").count()
        last = k == len(edges) - 1
        busy = counts.where(F.col("count") > crowd)
        n_busy = busy.limit(1).count()
        if not n_busy:
            done = current.withColumn("blocks", F.lit(1))
            tasks = done if tasks is None else tasks.unionByName(done)
            break
        if last:
            marked = current.join(busy, "cube", "left")
            done = marked.withColumn("blocks", F.ceil(F.coalesce(F.col("count"), F.lit(1)) / F.lit(crowd)).cast("int")).drop("count")
            tasks = done if tasks is None else tasks.unionByName(done)
            break
        calm = current.join(busy, "cube", "left_anti").withColumn("blocks", F.lit(1))
        tasks = calm if tasks is None else tasks.unionByName(calm)
        # Only the smaller cubes that lie in the crowded one are its children: others belong to other tasks.
        finer = edges[k + 1]
        ratio = int(round(edge / finer))
        inner = F.explode(F.filter(_cubes(xyz, F.lit(finer), reach), lambda c: (F.floor(c["i"] / ratio) == F.col("cube.i")) & (F.floor(c["j"] / ratio) == F.col("cube.j")) & (F.floor(c["k"] / ratio) == F.col("cube.k"))))
        current = current.join(busy, "cube", "left_semi").select("id", "lat", "lon", "x", "y", "z", F.lit(k + 1).alias("level"), inner.alias("cube_")).withColumnRenamed("cube_", "cube")
    own = None
    for k, edge in enumerate(edges):
        mine = (F.col("level") == k) & (F.col("cube") == cell(edge))
        own = mine if own is None else own | mine
    tasks = tasks.withColumn("own", own)
    # Blocks: a point stands in block h; task (g, h) with g <= h compares the two. With one block that is (0, 0).
    h = F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda g: F.struct(F.least(g, F.col("h")).alias("g"), F.greatest(g, F.col("h")).alias("h")))
    tasks = tasks.withColumn("h", h).withColumn("meet", F.explode(meet)).select("level", "cube", "meet", "h", "own", "id", "lat", "lon")

    def join_cube(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The pairs of one task, a chunk at a time: nothing that grows with their number is held."""
        ids, lat, lon, own_ = (pdf[c].to_numpy() for c in ("id", "lat", "lon", "own"))
        meet_, home = pdf["meet"].iloc[0], pdf["h"].to_numpy()
        left, right = (np.flatnonzero(home == meet_[x]) for x in ("g", "h"))
        xyz_ = chord_space(lat, lon)
        ta = BoxTree(xyz_[left])
        tb = ta if meet_["g"] == meet_["h"] else BoxTree(xyz_[right])
        for i, j, sure in dual_tree_pairs(ta, tb, reach):
            i, j = left[i], right[j]
            keep = ids[i] != ids[j]
            if ta is tb:
                keep &= ids[i] < ids[j]
            i, j = i[keep], j[keep]
            swap = ids[i] > ids[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            mine = own_[i]  # the cube of the smaller id reports
            i, j = i[mine], j[mine]
            if not sure:
                ok = haversine(lat[i], lon[i], lat[j], lon[j]) <= metres
                i, j = i[ok], j[ok]
            if len(i):
                yield pd.DataFrame({"left_id": ids[i], "right_id": ids[j]})

    # Calm cubes are many and small: a task takes a sorted run of them instead of a call to Python for each.
    def run(batches):
        hold = None
        for pdf in batches:
            if hold is not None:
                pdf = pd.concat([hold, pdf], ignore_index=True)
            code = pdf["task"].to_numpy()
            if not len(code):
                continue
            ends = np.flatnonzero(code[1:] != code[:-1]) + 1
            stop = int(ends[-1]) if len(ends) else 0
            hold = pdf.iloc[stop:]
            done = pdf.iloc[:stop]
            if len(done):
                yield from whole(done)
        if hold is not None and len(hold):
            yield from whole(hold)

    def whole(pdf):
        code = pdf["task"].to_numpy()
        starts = np.r_[0, np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)]
        outs, n = [], 0
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1:
                for out in join_cube(pdf.iloc[s:e]):
                    outs.append(out)
                    n += len(out)
                    if n > GIVEN_AT_ONCE:
                        yield pd.concat(outs, ignore_index=True)
                        outs, n = [], 0
        if outs:
            yield pd.concat(outs, ignore_index=True)

    # The exact cube is part of the key, so no two cubes ever share a task by a hash's chance.
    key = F.concat_ws(":", "level", "cube.i", "cube.j", "cube.k", "meet.g", "meet.h")
    keyed = tasks.select(key.alias("task"), "meet", "h", "own", "id", "lat", "lon")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "task").sortWithinPartitions("task").mapInPandas(run, "left_id long, right_id long").distinct()


# ---- regions -------------------------------------------------------------------------------------------------

#: A region is cut at the finest level at which its longer side spans at most so many cells.
SPAN = 16
FINEST = 24


def valid_bounds(b: Column) -> Column:
    """[west, south, east, north]: four finite values in range, west < east, south < north."""
    w, s, e, n = (F.get(b, F.lit(i)) for i in range(4))
    fine = (F.size(b) == 4) & ~F.isnan(w) & ~F.isnan(s) & ~F.isnan(e) & ~F.isnan(n)
    return F.coalesce(fine & (w >= -180) & (e <= 180) & (s >= -90) & (n <= 90) & (w < e) & (s < n), F.lit(False))


def region_cells(regions: DataFrame) -> DataFrame:
    """Quadtree cells (level, i, j) that cover each valid region, ``certain`` where wholly inside it.

    regions: region_no, bounds. A region gives at most (SPAN + 1)^2 cells whatever its size.
    """
    w, s, e, n = (F.col("bounds")[i] for i in range(4))
    level = F.least(F.lit(FINEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(180.0 * SPAN) / F.greatest(e - w, n - s))))).cast("int")
    d = F.col("edge")
    boxed = (
        regions.where(F.col("region_no").isNotNull() & valid_bounds(F.col("bounds")))
        .select("region_no", w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"), level.alias("level"))
        .withColumn("edge", F.lit(180.0) / F.pow(F.lit(2.0), F.col("level")))
    )
    cut = boxed.withColumn("i", F.explode(F.sequence(F.floor((F.col("w") + 180) / d), F.floor((F.col("e") + 180) / d)))).withColumn(
        "j", F.explode(F.sequence(F.floor((F.col("s") + 90) / d), F.floor((F.col("n") + 90) / d)))
    )
    # Strictly inside by a whole ulp-proof margin; everything else is refined.
    x, y, eps = F.col("i") * d - 180, F.col("j") * d - 90, d * 1e-6
    certain = (x - eps >= F.col("w")) & (x + d + eps <= F.col("e")) & (y - eps >= F.col("s")) & (y + d + eps <= F.col("n"))
    return cut.select("level", "i", "j", "region_no", "w", "s", "e", "n", certain.alias("certain"))


class RegionTree:
    """A tree of boxes (west, south, east, north): of each node the box around all its boxes and the one common to all."""

    def __init__(self, boxes: np.ndarray):
        centres = BoxTree((boxes[:, :2] + boxes[:, 2:]) / 2, leaf=4)
        self.order, self.begin, self.end, self.left = centres.order, centres.begin, centres.end, centres.left
        parts = [boxes[self.order[b:e]] for b, e in zip(self.begin, self.end)]
        self.around = np.array([np.r_[x[:, :2].min(axis=0), x[:, 2:].max(axis=0)] for x in parts]).reshape(-1, 4)
        self.common = np.array([np.r_[x[:, :2].max(axis=0), x[:, 2:].min(axis=0)] for x in parts]).reshape(-1, 4)


def dual_tree_inside(points: BoxTree, regions: RegionTree):
    """Chunks (i, k, certain) of points (lon, lat) and boxes that may contain them.

    Pairs of nodes whose boxes do not meet are discarded; where the points' box lies within what all the regions have in
    common they are accepted with all their members; the larger of an uncertain pair is opened, and pairs of leaves come
    out as uncertain.
    """
    if not len(points.begin) or not len(regions.begin):
        return
    p, q = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        low, high = points.low[p], points.high[p]
        meet = (low <= regions.around[q, 2:]).all(axis=1) & (high >= regions.around[q, :2]).all(axis=1)
        p, q, low, high = p[meet], q[meet], low[meet], high[meet]
        certain = (low >= regions.common[q, :2]).all(axis=1) & (high <= regions.common[q, 2:]).all(axis=1)
        ends = ~certain & (points.left[p] < 0) & (regions.left[q] < 0)
        for chosen, sure in ((certain, True), (ends, False)):
            yield from _expand(points, regions, p[chosen], q[chosen], sure)
        rest = ~certain & ~ends
        p, q = p[rest], q[rest]
        open_p = (points.left[p] >= 0) & ((regions.left[q] < 0) | (points.end[p] - points.begin[p] >= regions.end[q] - regions.begin[q]))
        pp, qp, pq, qq = p[open_p], q[open_p], p[~open_p], q[~open_p]
        p = np.concatenate([points.left[pp], points.left[pp] + 1, pq, pq])
        q = np.concatenate([qp, qp, regions.left[qq], regions.left[qq] + 1])


#: Regions up to which their tree goes to every task: 32 bytes each, and as much again for its nodes.
BROADCAST_REGIONS = 100_000


def regions_of_points(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Every region whose valid bounds contain a point, borders included.

    points: point_id, lat, lon, geohash; the position is lat and lon if usable, else the centre of the
    cell the geohash names (any length, case and surrounding blanks ignored), else there is none and
    the point is in no region. regions: region_no, bounds; invalid bounds contain nothing. Null ids
    are skipped, repeated rows count once, empty tables give no rows.
    Result: distinct (point_id, region_no).
    """
    good = usable_position(F.col("lat"), F.col("lon"))
    centre = F.when(~good, geohash_centre(F.col("geohash")))
    p = (
        points.where("point_id is not null")
        .select("point_id", "lat", "lon", "geohash")
        .withColumn("_c", centre)
        .select("point_id", F.when(good, F.col("lat")).otherwise(F.col("_c.lat")).alias("lat"), F.when(good, F.col("lon")).otherwise(F.col("_c.lon")).alias("lon"))
        .where("lat is not null and lon is not null")
    )
    valid = regions.where(F.col("region_no").isNotNull() & valid_bounds(F.col("bounds"))).select("region_no", "bounds").distinct()
    few = valid.limit(BROADCAST_REGIONS + 1).collect()
    if len(few) > BROADCAST_REGIONS:
        return _by_cells(p, valid).distinct()
    if not few:
        return p.select("point_id", F.lit(0).cast("long").alias("region_no")).limit(0)
    numbers, boxes = np.array([r["region_no"] for r in few], np.int64), np.array([r["bounds"] for r in few], float)
    shared = points.sparkSession.sparkContext.broadcast((numbers, boxes, RegionTree(boxes)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, boxes, tree = shared.value
        for pdf in batches:
            ids, at = pdf["point_id"].to_numpy(), pdf[["lon", "lat"]].to_numpy(float)
            for i, k, sure in dual_tree_inside(BoxTree(at), tree):
                if not sure:
                    ok = (at[i] >= boxes[k, :2]).all(axis=1) & (at[i] <= boxes[k, 2:]).all(axis=1)
                    i, k = i[ok], k[ok]
                if len(i):
                    yield pd.DataFrame({"point_id": ids[i], "region_no": numbers[k]})

    return p.mapInPandas(run, "point_id long, region_no long").distinct()


def _by_cells(p: DataFrame, regions: DataFrame) -> DataFrame:
    """(point_id, region_no) for any number of regions, by an equi-join on quadtree cells. p: point_id, lat, lon."""
    cells = region_cells(regions)
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # at most FINEST + 1 numbers
    at = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("level"), F.floor((F.col("lon") + 180) / (180.0 / 2**k)).alias("i"), F.floor((F.col("lat") + 90) / (180.0 / 2**k)).alias("j")) for k in levels]))
    placed = p.withColumn("_at", at).select("point_id", "lat", "lon", "_at.level", "_at.i", "_at.j")
    inside = F.col("certain") | (F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    return placed.join(cells, ["level", "i", "j"]).where(inside).select("point_id", "region_no")

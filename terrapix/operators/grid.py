"""Grids: bounds, tiles, patches, sampling, rasterising, resampling, mosaics, tile-wise equalisation.

A cell is addressed by integer (row, col); every raster-raster and raster-vector step is an equi-join on such keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .places import blocks, shapes, unfold, with_shape


def raster_bounds(meta: DataFrame) -> DataFrame:
    """Adds minx, miny, maxx, maxy from the affine terms a (cell width), e (negative height), c, f (origin)."""
    x2, y2 = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    return meta.withColumns({"minx": F.least("c", x2), "maxx": F.greatest("c", x2), "miny": F.least("f", y2), "maxy": F.greatest("f", y2)})


def tile_bounds(meta: DataFrame, tile: int) -> DataFrame:
    """One row for each tile of a raster: its cell range and bounds, clipped at the raster's far edges."""
    last = lambda n: F.ceil(F.col(n) / tile).cast("int") - 1
    t = meta.withColumn("i", F.explode(F.sequence(F.lit(0), last("height")))).withColumn("j", F.explode(F.sequence(F.lit(0), last("width"))))
    stop = lambda k, n: F.least((F.col(k) + 1) * tile, F.col(n))
    return t.select(
        "raster_id", "i", "j",
        (F.col("c") + F.col("a") * F.col("j") * tile).alias("minx"), (F.col("c") + F.col("a") * stop("j", "width")).alias("maxx"),
        (F.col("f") + F.col("e") * stop("i", "height")).alias("miny"), (F.col("f") + F.col("e") * F.col("i") * tile).alias("maxy"),
    )


def assign_tiles(df: DataFrame, tile: int) -> DataFrame:
    """Adds tile_i and tile_j, keys to partition a stored raster by."""
    return df.withColumns({"tile_i": F.floor(F.col("row") / tile).cast("int"), "tile_j": F.floor(F.col("col") / tile).cast("int")})


def crop_to_multiple(df: DataFrame, height: int | Column, width: int | Column, size: int) -> DataFrame:
    """Without the rows and columns past the last whole multiple of `size`."""
    return df.where((F.col("row") < height - height % size) & (F.col("col") < width - width % size))


def patches(df: DataFrame, height: int | Column, width: int | Column, size: int, step: int) -> DataFrame:
    """Each pixel in every patch that covers it: patch_i, patch_j and its place (pr, pc) there. No join is needed."""

    def covering(at: Column, n: int | Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step)).cast("int")
        last = F.least(F.floor((F.lit(n) - size) / step), F.floor(at / step)).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    out = df.withColumn("patch_i", F.explode(covering(F.col("row"), height))).withColumn("patch_j", F.explode(covering(F.col("col"), width)))
    return out.withColumns({"pr": (F.col("row") - F.col("patch_i") * step).cast("int"), "pc": (F.col("col") - F.col("patch_j") * step).cast("int")})


def patch_origins(meta: DataFrame, height: int, width: int, step_i: int, step_j: int) -> DataFrame:
    """One row for each whole patch of a raster: patch_i, patch_j and its first corner (x0, y0)."""
    index = lambda n, size, step: F.explode(F.when(F.col(n) >= size, F.sequence(F.lit(0), F.floor((F.col(n) - size) / step).cast("int"))))
    t = meta.withColumn("patch_i", index("height", height, step_i)).withColumn("patch_j", index("width", width, step_j))
    return t.select("raster_id", "patch_i", "patch_j", (F.col("c") + F.col("patch_j") * step_j * F.col("a")).alias("x0"), (F.col("f") + F.col("patch_i") * step_i * F.col("e")).alias("y0"))


def sample_raster(raster: DataFrame, points: DataFrame, x: str, y: str, a: float = 1.0, c: float = 0.0, e: float = 1.0, f: float = 0.0) -> DataFrame:
    """Points with the values of the cell they lie in. A point on an edge belongs to the cell right of it or below.

    Spark picks the join by size: few points are broadcast, many are shuffled by cell.
    """
    cell = points.withColumns({"col": F.floor((F.col(x) - c) / a).cast("long"), "row": F.floor((F.col(y) - f) / e).cast("long")})
    return cell.join(raster, ["row", "col"])


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of x, y), by counting crossings; left and lower edges are inside."""
    n = F.size(ring)
    steps = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(F.element_at(ring, k).alias("p"), F.element_at(ring, F.when(k == n, 1).otherwise(k + 1)).alias("q")))

    def crosses(s: Column) -> Column:
        p, q = s["p"], s["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        return spans & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"])

    return F.size(F.filter(steps, crosses)) % 2 == 1


def with_bounds(polygons: DataFrame) -> DataFrame:
    get = lambda k, f: f(F.transform("ring", lambda p: p[k]))
    return polygons.withColumns({"minx": get("x", F.array_min), "maxx": get("x", F.array_max), "miny": get("y", F.array_min), "maxy": get("y", F.array_max)})


def candidates(points: DataFrame, polygons: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Point-polygon pairs that share a grid cell: polygons are listed under the cells of their bounds, then an equi-join."""
    key = lambda v: F.floor(v / cell).cast("long")
    b = with_bounds(polygons)
    b = b.withColumn("gx", F.explode(F.sequence(key(F.col("minx")), key(F.col("maxx"))))).withColumn("gy", F.explode(F.sequence(key(F.col("miny")), key(F.col("maxy")))))
    return points.withColumns({"gx": key(F.col(x)), "gy": key(F.col(y))}).join(b, ["gx", "gy"]).drop("gx", "gy")


def place_hits(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", cell: float = 16.0) -> DataFrame:
    """(x, y, shape, ring): distinct places of points and the distinct rings they lie in."""
    places = points.select(x, y).distinct()
    return candidates(places, shapes(polygons), x, y, cell).where(in_ring(F.col(x), F.col(y), F.col("ring"))).select(x, y, "shape", "ring")


def spatial_join(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", cell: float = 16.0) -> DataFrame:
    """Pairs of points and the polygons they lie in.

    Places and rings are compared once each; the points and polygons that share them meet in blocks.
    """
    return _unfold_hits(place_hits(points, polygons, x, y, cell), points, polygons, x, y)


def _unfold_hits(hits: DataFrame, points: DataFrame, polygons: DataFrame, x: str, y: str) -> DataFrame:
    own, theirs = [c for c in points.columns if c not in (x, y)], [c for c in polygons.columns if c != "ring"]
    item = lambda columns: F.struct(*columns) if columns else F.struct(F.lit(0).alias("_"))
    out = unfold(hits, blocks(points, [x, y], item(own)), blocks(with_shape(polygons), ["shape"], item(theirs)), [x, y], ["shape"])
    taken = [F.col(c) if c in (x, y) else F.col(f"l.{c}").alias(c) for c in points.columns]
    return out.select(*taken, *(F.col(c) if c == "ring" else F.col(f"r.{c}").alias(c) for c in polygons.columns))


def spatial_join_left(points: DataFrame, polygons: DataFrame, unique: list[str], x: str = "x", y: str = "y", cell: float = 16.0) -> DataFrame:
    """As spatial_join, with points in no polygon kept once, without one. Ids are unique; rows are told apart by place."""
    hits = place_hits(points, polygons, x, y, cell)
    inside = _unfold_hits(hits, points, polygons, x, y)
    return inside.unionByName(points.join(hits.select(x, y).distinct(), [x, y], "left_anti"), allowMissingColumns=True)


def clip(points: DataFrame, polygons: DataFrame, unique: list[str], x: str = "x", y: str = "y", invert: bool = False) -> DataFrame:
    """Points in any polygon, or in none. Ids are unique; rows are told apart by place, so no pair is made."""
    hit = place_hits(points, polygons, x, y).select(x, y).distinct()
    return points.join(hit, [x, y], "left_anti" if invert else "left_semi")


def points_in(points: DataFrame, polygons: DataFrame, poly_id: str, x: str = "x", y: str = "y", cell: float = 16.0) -> DataFrame:
    """(poly_id, points): the number of points in each polygon that holds any, from counts of places."""
    counts = points.groupBy(x, y).agg(F.count("*").alias("points"))
    held = place_hits(counts, polygons, x, y, cell).drop("ring").join(counts, [x, y]).groupBy("shape").agg(F.sum("points").alias("points"))
    return with_shape(polygons).select(poly_id, "shape").join(held, "shape").groupBy(poly_id).agg(F.sum("points").alias("points"))


def downsample(df: DataFrame, factor: int, bands: list[str]) -> DataFrame:
    """Mean of `factor` x `factor` cells, nulls left out."""
    by = [F.floor(F.col(k) / factor).cast("long").alias(k) for k in ("row", "col")]
    return df.groupBy(*by).agg(*(F.avg(b).alias(b) for b in bands))


def bilinear(df: DataFrame, band: str, factor: int) -> DataFrame:
    """A grid `factor` times as fine: each new cell from the four old ones around its centre, those that exist weighted.

    Old cells send their share to the new cells they touch, and shares are summed; a new cell lies within an old one that exists.
    """
    out = []
    for name in ("row", "col"):
        first, last = (F.col(name) - 0.5) * factor - 0.5, (F.col(name) + 1.5) * factor - 0.5
        out.append(F.sequence(F.greatest(F.floor(first) + 1, F.lit(0)).cast("long"), (F.ceil(last) - 1).cast("long")))
    weight = lambda new, old: 1 - F.abs((F.col(new) + 0.5) / factor - 0.5 - F.col(old))
    fine = df.where(F.col(band).isNotNull()).select("row", "col", band).withColumn("r", F.explode(out[0])).withColumn("c", F.explode(out[1]))
    fine = fine.withColumn("w", weight("r", "row") * weight("c", "col")).where("w > 0")
    within = (F.floor(F.col("r") / factor) == F.col("row")) & (F.floor(F.col("c") / factor) == F.col("col"))
    made = fine.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg(F.try_divide(F.sum(F.col(band) * F.col("w")), F.sum("w")).alias(band), F.bool_or(within).alias("within"))
    return made.where("within").drop("within")


def mosaic(df: DataFrame, band: str, priority: str) -> DataFrame:
    """One grid from overlapping rasters: per cell the value of highest priority that isn't null."""
    return df.where(F.col(band).isNotNull()).groupBy("row", "col").agg(F.max_by(band, priority).alias(band))


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (north of the equator) of WGS84 degrees, by the transverse Mercator series."""
    a, k0, e2 = 6378137.0, 0.9996, 0.00669437999014
    ep2 = e2 / (1 - e2)
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, q = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * dl
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = k0 * n * (q + (1 - t + c) * q**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * q**5 / 120) + 500000.0
    north = k0 * (m + n * F.tan(phi) * (q**2 / 2 + (5 - t + 9 * c + 4 * c**2) * q**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * q**6 / 720))
    return east, north


def equalise_tiles(df: DataFrame, value: str, tile: int, levels: int = 256, clip_limit: float = 2.0) -> DataFrame:
    """Contrast-limited histogram equalisation of each tile; zeros stay zero.

    Counts over clip_limit times the even share are cut and dealt out evenly, in whole counts; the running sum is the
    look-up table, joined back by tile and value. Windows hold one tile's values, `levels` at most.
    """
    tiled = assign_tiles(df, tile)
    hist = tiled.where(F.col(value) > 0).groupBy("tile_i", "tile_j", value).agg(F.count("*").alias("n"))
    total = hist.groupBy("tile_i", "tile_j").agg(F.sum("n").alias("total"))
    hist = hist.join(total, ["tile_i", "tile_j"]).withColumn("cap", F.greatest(F.lit(1), F.floor(clip_limit * F.col("total") / levels)))
    excess = hist.groupBy("tile_i", "tile_j").agg(F.sum(F.greatest(F.col("n") - F.col("cap"), F.lit(0))).alias("excess"))
    w = Window.partitionBy("tile_i", "tile_j").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    lut = hist.join(excess, ["tile_i", "tile_j"]).withColumn("cum", F.sum(F.least("n", "cap")).over(w) + F.col("excess") * F.col(value) / levels)
    lut = lut.select("tile_i", "tile_j", value, F.floor(F.col("cum") / F.col("total") * (levels - 1)).cast("int").alias("equalised"))
    return tiled.join(lut, ["tile_i", "tile_j", value], "left").withColumn("equalised", F.coalesce("equalised", F.lit(0)))


def augment(df: DataFrame, size: int, seed: int, keys: list[str], bands: list[str]) -> DataFrame:
    """Each patch flipped or not and made lighter or darker by a draw that its key and the seed fix; clipped to [0, 1]."""
    flip, delta = draw(seed, "f", keys) < 0.5, draw(seed, "b", keys) - 0.5
    return df.withColumns({"pc": F.when(flip, size - 1 - F.col("pc")).otherwise(F.col("pc")), **{b: F.least(F.greatest(F.col(b) + delta, F.lit(0.0)), F.lit(1.0)) for b in bands}})


def laea_europe(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in the European equal-area grid (3035), from GRS80 degrees."""
    a, e2 = 6378137.0, 0.00669438002290
    e, lat0, lon0 = math.sqrt(e2), math.radians(52), math.radians(10)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    qp, q0 = q_of(1.0), q_of(math.sin(lat0))
    beta0, rq = math.asin(q0 / qp), a * math.sqrt(qp / 2)
    dd = a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e))
    beta, dl = F.asin(q / qp), F.radians(lon) - lon0
    b = rq * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(dl)))
    return 4321000.0 + b * dd * F.cos(beta) * F.sin(dl), 3210000.0 + b / dd * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(dl))


def resample(df: DataFrame, band: str, height: int, width: int, a: float, c: float, e: float, f: float, method: str = "bilinear") -> DataFrame:
    """(row, col, band) on any grid: target cell (row, col) has its centre at x = c + a (col + 0.5), y = f + e (row + 0.5).

    x and y are in cells of the source. nearest: the value of the cell that the centre lies in. bilinear: the four source
    cells round the centre, weighted by how near their centres are; those that are missing or null have no weight. Either
    way the cell that the centre lies in must exist and have a value, so the source's outline is kept. Target cells are
    made in parallel, and each meets its source cells in one equi-join.
    """
    cells = df.sparkSession.range(height * width).select((F.col("id") / width).cast("long").alias("r"), (F.col("id") % width).alias("k"))
    x, y = F.lit(c) + F.lit(a) * (F.col("k") + 0.5), F.lit(f) + F.lit(e) * (F.col("r") + 0.5)
    own = cells.withColumns({"x": x, "y": y}).withColumns({"r0": F.floor("y").cast("long"), "c0": F.floor("x").cast("long")})
    source = df.where(F.col(band).isNotNull()).select("row", "col", band)
    if method == "nearest":
        return own.select("r", "k", F.col("r0").alias("row"), F.col("c0").alias("col")).join(source, ["row", "col"]).select(F.col("r").alias("row"), F.col("k").alias("col"), band)
    if method != "bilinear":
        raise ValueError(method)
    first = own.withColumns({"r1": F.floor(F.col("y") - 0.5).cast("long"), "c1": F.floor(F.col("x") - 0.5).cast("long")})
    four = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
    near = first.withColumn("n", F.explode(four)).withColumns({"row": F.col("r1") + F.col("n.i"), "col": F.col("c1") + F.col("n.j")})
    weight = (1 - F.abs(F.col("y") - 0.5 - F.col("row"))) * (1 - F.abs(F.col("x") - 0.5 - F.col("col")))
    near = near.withColumns({"w": weight, "is_own": (F.col("row") == F.col("r0")) & (F.col("col") == F.col("c0"))})
    made = near.join(source, ["row", "col"]).groupBy("r", "k").agg(F.try_divide(F.sum(F.col(band) * F.col("w")), F.sum("w")).alias(band), F.bool_or("is_own").alias("within"))
    return made.where("within").select(F.col("r").alias("row"), F.col("k").alias("col"), band)


def draw(seed: int, salt: str, keys: list[str]) -> Column:
    """A number in [0, 1) that follows from the seed, a salt and a patch's key."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(f"{seed}{salt}"), *keys)), 1, 6), 16, 10).cast("double") / (16**6)


def random_crop(df: DataFrame, size: int, pad: int, seed: int, keys: list[str], bands: list[str], fill: float = 0.0) -> DataFrame:
    """Each patch padded by `pad` cells on every side and cut to its size again at a place that its key and the seed draw.

    df: keys, pr and pc (0 ... size - 1) and bands, image and mask alike, which are shifted together. The result has all
    size * size cells of each patch; those from the padding, or missing in the patch, have `fill`. A null band of a
    cell that is there stays null.
    """
    shift = lambda salt: (F.floor(draw(seed, salt, keys) * (2 * pad + 1)) - pad).cast("int")
    moves = df.select(*keys).distinct().withColumns({"dy": shift("y"), "dx": shift("x")})
    line = F.sequence(F.lit(0), F.lit(size - 1))
    frame = moves.withColumn("pr", F.explode(line)).withColumn("pc", F.explode(line))
    inner = df.select(*keys, F.col("pr").alias("sr"), F.col("pc").alias("sc"), F.lit(True).alias("there"), *bands)
    wide = frame.withColumns({"sr": (F.col("pr") + F.col("dy")).cast("int"), "sc": (F.col("pc") + F.col("dx")).cast("int")})
    out = wide.join(inner, [*keys, "sr", "sc"], "left")
    return out.select(*keys, "pr", "pc", *(F.when(F.col("there"), F.col(b)).otherwise(F.lit(fill)).alias(b) for b in bands))

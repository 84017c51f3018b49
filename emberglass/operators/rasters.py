"""Grids of cells: rasters kept as tiles, slopes across their borders, shapes drawn on cells, and distances on grids.

A raster is a table of tiles (tile_row, tile_col, values: an array of side * side numbers, rows from the north, null where
nothing is known). Cell (row, col) is in tile (row div side, col div side).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = "tile_row long, tile_col long, values array<double>"


def cell_of(lat: Column, lon: Column, north: float, west: float, size: float) -> tuple[Column, Column]:
    """(row, col) of a raster whose north-west corner is (north, west) and whose cells are size degrees wide."""
    return F.floor((F.lit(north) - lat) / size).cast("long"), F.floor((lon - F.lit(west)) / size).cast("long")


def _div(c: Column, side: int) -> Column:
    return F.floor(c / side).cast("long")


def sampled(points: DataFrame, tiles: DataFrame, side: int, north: float, west: float, size: float) -> DataFrame:
    """points (lat, lon, ...) with value, that of the cell they lie in; null where there is no tile or nothing is known.
    Points meet tiles in an equality join on the tile, so a tile is sent once for all its points."""
    row, col = cell_of(F.col("lat"), F.col("lon"), north, west, size)
    p = points.withColumns({"_row": row, "_col": col}).withColumns({"tile_row": _div(F.col("_row"), side), "tile_col": _div(F.col("_col"), side)})
    at = (F.col("_row") - F.col("tile_row") * side) * side + F.col("_col") - F.col("tile_col") * side
    met = p.join(tiles.select("tile_row", "tile_col", "values"), ["tile_row", "tile_col"], "left")
    return met.select(*points.columns, F.get("values", at.cast("int")).alias("value"))


def tiled(cells: DataFrame, side: int) -> DataFrame:
    """Tiles of cells (row, col, value); of several values of a cell the greatest."""
    one = cells.groupBy("row", "col").agg(F.max("value").cast("double").alias("value"))
    at = ((F.pmod("row", F.lit(side))) * side + F.pmod("col", F.lit(side))).cast("int")
    g = one.groupBy(_div(F.col("row"), side).alias("tile_row"), _div(F.col("col"), side).alias("tile_col"))
    held = g.agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("value").alias("v")))).alias("m"))  # side * side entries
    return held.select("tile_row", "tile_col", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.try_element_at("m", k)).alias("values"))


def cells(tiles: DataFrame, side: int, *columns: str) -> DataFrame:
    """(row, col, and each column's number) of the cells of tiles, unknown ones included."""
    names = columns or ("values",)
    flat = tiles.select("tile_row", "tile_col", F.posexplode(F.arrays_zip(*names)).alias("k", "v"))
    return flat.select((F.col("tile_row") * side + F.floor(F.col("k") / side)).alias("row"), (F.col("tile_col") * side + F.col("k") % side).alias("col"), *[F.col(f"v.{c}").alias("value" if c == "values" else c) for c in names])


def mosaic(layers: DataFrame) -> DataFrame:
    """One raster of tiles in layers (layer, tile_row, tile_col, values): a cell has the value of the least layer that knows
    it, so later layers fill only empty cells. Layers of a tile meet cell by cell, in partial aggregates."""
    flat = layers.select("layer", "tile_row", "tile_col", F.size("values").alias("n"), F.posexplode("values").alias("k", "v"))
    best = flat.groupBy("tile_row", "tile_col", "k").agg(F.max("n").alias("n"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("layer"))).alias("v"))
    whole = best.groupBy("tile_row", "tile_col").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("kv"))  # a tile's cells
    return whole.select("tile_row", "tile_col", F.transform("kv", lambda x: x["v"]).alias("values"))


def with_halo(tiles: DataFrame, side: int) -> DataFrame:
    """tiles with north, south, west, east: the rows and columns of cells beyond their edges, null where there is no tile.

    Every tile sends its four edge strips to its neighbours and itself to itself: one shuffle of tiles and strips, whatever
    the raster's size, and no tile meets a whole other one.
    """
    v, last = F.col("values"), side - 1
    strip = lambda first, step: F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.get(v, k * step + first))
    sent = [(0, 0, "values", v), (-1, 0, "south", strip(0, 1)), (1, 0, "north", strip(last * side, 1)), (0, -1, "east", strip(0, side)), (0, 1, "west", strip(last, side))]
    parts = F.array(*[F.struct((F.col("tile_row") + r).alias("tile_row"), (F.col("tile_col") + c).alias("tile_col"), F.lit(what).alias("what"), part.alias("part")) for r, c, what, part in sent])
    flat = tiles.select(F.inline(parts))
    of = lambda what: F.first(F.when(F.col("what") == what, F.col("part")), ignorenulls=True).alias(what)
    return flat.groupBy("tile_row", "tile_col").agg(*[of(what) for *_, what, _ in sent]).filter("values is not null")


def slopes(tiles: DataFrame, side: int, north: float, size: float) -> DataFrame:
    """tiles (tile_row, tile_col) with slope and aspect (arrays of degrees, as of slope_aspect() in geo.py).

    A rise is taken between a cell's neighbours, across tiles too, or from the cell itself where one of the two is missing
    or unknown; it is null where both are, and so are slope and aspect, and for cells unknown themselves. Metres are those
    of the row's latitude.
    """
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("tile_row", "tile_col")] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("slope", "aspect")])
    around = ("values", "north", "south", "west", "east")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slope, aspect = [], []
            tile_rows = batch.column("tile_row").to_pylist()
            for k, tile_row in enumerate(tile_rows):
                padded = np.full((side + 2, side + 2), np.nan)
                for name, where in zip(around, (np.s_[1:-1, 1:-1], np.s_[0, 1:-1], np.s_[-1, 1:-1], np.s_[1:-1, 0], np.s_[1:-1, -1])):
                    part = batch.column(name)[k].as_py()
                    if part is not None:
                        padded[where] = np.array(part, float).reshape(padded[where].shape)
                a, b = _slope(padded, north - (tile_row * side + np.arange(side) + 0.5) * size, size)
                slope.append([None if np.isnan(x) else float(x) for x in a.ravel()])
                aspect.append([None if np.isnan(x) else float(x) for x in b.ravel()])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            columns = [tile_rows, batch.column("tile_col").to_pylist(), slope, aspect]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], schema.names)

    return with_halo(tiles, side).select("tile_row", "tile_col", *around).mapInArrow(each, schema)


def _slope(padded: np.ndarray, lat: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    p = np.radians(lat)[:, None]
    of_lat = 111132.92 - 559.82 * np.cos(2 * p) + 1.175 * np.cos(4 * p) - 0.0023 * np.cos(6 * p)
    of_lon = 111412.84 * np.cos(p) - 93.5 * np.cos(3 * p) + 0.118 * np.cos(5 * p)
    here = padded[1:-1, 1:-1]

    def rise(before: np.ndarray, after: np.ndarray, metres: np.ndarray) -> np.ndarray:
        steps = (~np.isnan(before)).astype(float) + ~np.isnan(after)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = (np.where(np.isnan(after), here, after) - np.where(np.isnan(before), here, before)) / (steps * metres)
        return np.where((steps > 0) & ~np.isnan(here), d, np.nan)

    east = rise(padded[1:-1, :-2], padded[1:-1, 2:], of_lon * size)
    south = rise(padded[:-2, 1:-1], padded[2:, 1:-1], of_lat * size)
    return np.degrees(np.arctan(np.hypot(east, south))), np.mod(np.degrees(np.arctan2(-east, south)) + 360, 360)


def ring_edges(rings: DataFrame, size: float) -> DataFrame:
    """(id, y1, x1, y2, x2) in cells, of rings (id, ring: array of lat, lon), closed if they are open."""
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.array(F.element_at("ring", 1))))
    rows = rings.filter(F.size("ring") > 0).select("id", closed.alias("ring"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ring") - 2)), lambda i: F.struct(F.get("ring", i).alias("p"), F.coalesce(F.get("ring", i + 1), F.get("ring", i)).alias("q")))
    e = rows.select("id", F.explode(pairs).alias("e"))
    return e.select("id", *[(F.col(f"e.{p}.{c}") / size).alias(n) for p, c, n in (("p", "lat", "y1"), ("p", "lon", "x1"), ("q", "lat", "y2"), ("q", "lon", "x2"))])


def touched(edges: DataFrame) -> DataFrame:
    """(id, row, col) of every cell that an edge has a point in.

    An edge walks the rows of cells that it spans; in a row it has all columns between the ones where it comes in and goes
    out. So each is listed once, and no cell is tested that the edge does not touch.
    """
    down, up = F.least("y1", "y2"), F.greatest("y1", "y2")
    e = edges.withColumn("row", F.explode(F.sequence(F.floor(down).cast("long"), F.floor(up).cast("long"))))
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1"))
    a, b = at(F.greatest(down, F.col("row").cast("double"))), at(F.least(up, (F.col("row") + 1).cast("double")))
    level = F.col("y1") == F.col("y2")
    held = lambda x: F.greatest(F.least("x1", "x2"), F.least(x, F.greatest("x1", "x2")))
    a, b = F.when(level, F.col("x1")).otherwise(held(a)), F.when(level, F.col("x2")).otherwise(held(b))
    cols = F.sequence(F.floor(F.least(a, b)).cast("long"), F.floor(F.greatest(a, b)).cast("long"))
    return e.select("id", "row", F.explode(cols).alias("col"))


def filled(edges: DataFrame) -> DataFrame:
    """(id, row, col) of every cell whose centre lies inside by the even-odd rule: a line through each row's centres, from
    each odd crossing to the next."""
    down, up = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(down - 0.5).cast("long"), F.ceil(up - 0.5).cast("long") - 1
    e = edges.filter(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    x = F.col("x1") + (F.col("x2") - F.col("x1")) * (F.col("row") + 0.5 - F.col("y1")) / (F.col("y2") - F.col("y1"))
    w = Window.partitionBy("id", "row").orderBy("x")
    pairs = e.select("id", "row", x.alias("x")).select("id", "row", "x", F.lead("x").over(w).alias("to"), F.row_number().over(w).alias("nth")).filter("nth % 2 = 1")
    a, b = F.ceil(F.col("x") - 0.5).cast("long"), F.ceil(F.col("to") - 0.5).cast("long") - 1
    return pairs.filter(a <= b).select("id", "row", F.explode(F.sequence(a, b)).alias("col"))


def rasterised(rings: DataFrame, size: float, all_touched: bool = True) -> DataFrame:
    """(id, row, col), each once, of the cells of size degrees that the rings of an id (several make holes and parts) hold:
    those whose centre is inside and, with all_touched, those that an edge touches."""
    edges = ring_edges(rings, size)
    inside = filled(edges)
    return (inside.union(touched(edges)) if all_touched else inside).distinct()


def distances(asked: DataFrame, by: str) -> DataFrame:
    """(by, row, col, distance): of each cell of asked (by, row, col, active) the exact Euclidean distance in cells to the
    nearest active one of its group; null if there is none, and for rows without a group.

    In two passes. Along each column that has active cells, every asked row gets the distance to the nearest of them. Along
    each row these make parabolas, whose lower envelope gives the distance at every cell. The work is the rows times the
    columns of a grid; a task holds one of its rows.
    """
    cell = asked.select(F.col(by).alias("g"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "active").filter("row is not null and col is not null")
    active = cell.filter("active").select("g", "row", "col").distinct()
    lines = cell.select("g", "row").distinct().join(active.select("g", "col").distinct(), "g")
    both = active.select("g", "col", "row", F.col("row").alias("at")).unionByName(lines.select("g", "col", "row", F.lit(None).cast("long").alias("at")))
    w = Window.partitionBy("g", "col").orderBy("row")
    above, below = F.last("at", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.first("at", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("row") - above, below - F.col("row"))  # least passes over nulls
    column = both.select("g", "col", "row", "at", near.alias("near")).filter("at is null")
    parabolas = column.groupBy("g", "row").agg(F.array_sort(F.collect_list(F.struct("col", "near"))).alias("ps"))
    wanted = cell.groupBy("g", "row").agg(F.array_sort(F.collect_set("col")).alias("cols"))
    met = wanted.join(parabolas, ["g", "row"])
    schema = T.StructType([met.schema["g"], T.StructField("row", T.LongType()), T.StructField("cols", T.ArrayType(T.LongType())), T.StructField("ds", T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds = []
            for cols, ps in zip(batch.column("cols").to_pylist(), batch.column("ps").to_pylist()):
                ds.append(np.sqrt(envelope([p["col"] for p in ps], [p["near"] ** 2 for p in ps], cols)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("row"), batch.column("cols"), pa.array(ds, pa.list_(pa.float64()))], schema.names)

    found = met.select("g", "row", "cols", "ps").mapInArrow(each, schema)
    found = found.select("g", "row", F.inline(F.arrays_zip(F.col("cols").alias("col"), F.col("ds").alias("distance"))))
    same = F.col("c.g").eqNullSafe(F.col("f.g")) & (F.col("c.row") == F.col("f.row")) & (F.col("c.col") == F.col("f.col"))
    out = cell.select("g", "row", "col").alias("c").join(found.alias("f"), same, "left")
    return out.select(F.col("c.g").alias(by), F.col("c.row").alias("row"), F.col("c.col").alias("col"), "f.distance")


def envelope(at: list[int], height: list[int], cols: list[int]) -> np.ndarray:
    """min over k of (c - at[k])**2 + height[k] for each c of cols; at and cols ascend. Whole numbers throughout."""
    lowest: list[int] = []
    starts: list[float] = []  # where a parabola of lowest begins to be the lowest
    for k in range(len(at)):
        start = -np.inf
        while lowest:
            j = lowest[-1]
            start = ((at[k] ** 2 + height[k]) - (at[j] ** 2 + height[j])) / (2 * (at[k] - at[j]))
            if start > starts[-1]:
                break
            lowest.pop()
            starts.pop()
            start = -np.inf
        lowest.append(k)
        starts.append(start)
    k = np.searchsorted(np.array(starts), np.array(cols, float), side="right") - 1
    chosen = np.array(lowest)[k]
    return (np.array(cols, float) - np.array(at, float)[chosen]) ** 2 + np.array(height, float)[chosen]

"""Cell octrees on cubic grids and their interaction lists: U (adjacent leaves), V (children of the parent's neighbours
that aren't adjacent), and near lists across levels (U, W and X together)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larchpoint.functions import morton
from larchpoint.operators.layout import starts
from larchpoint.sources.points import exact_bounds
from larchpoint.storage import keep, with_rank


@dataclass(frozen=True)
class Grid:
    """A cube and the depth of its finest cells."""

    low: tuple[float, float, float]
    span: float
    depth: int


def grid_of(points: DataFrame, depth: int) -> Grid:
    box = exact_bounds(points)
    return Grid(box.low, max(box.span) * (1 + 1e-6), depth)


def place(points: DataFrame, grid: Grid) -> DataFrame:
    """Points with the cell of the finest level that they are in."""
    top = 2**grid.depth
    at = [F.least(F.greatest(F.floor((F.col(a) - F.lit(low)) / F.lit(grid.span) * F.lit(float(top))), F.lit(0)), F.lit(top - 1)).cast("long") for a, low in zip("xyz", grid.low, strict=True)]
    return points.withColumn("cell", morton.interleave(*at))


def offsets(spark: SparkSession) -> DataFrame:
    """The 26 neighbours' displacements."""
    rows = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]
    return spark.createDataFrame(rows, "ox long, oy long, oz long")


def with_axes(cells: DataFrame, own: str = "cell", to: str = "j") -> DataFrame:
    """cells with their integer coordinates, in columns of their own: nested bit expressions would grow exponentially."""
    return cells.withColumns({f"{to}{a}": c for a, c in zip("xyz", morton.axes(F.col(own)), strict=True)})


def neighbours(cells: DataFrame, own: str = "cell", level: str = "level") -> DataFrame:
    """cells with a row for each of their neighbour places inside the cube, in column `there`."""
    out = with_axes(cells, own).crossJoin(F.broadcast(offsets(cells.sparkSession)))  # 26 rows
    out = out.withColumns({f"n{a}": F.col(f"j{a}") + F.col(f"o{a}") for a in "xyz"})
    top = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(level).cast("int"))
    inside = F.lit(True)
    for a in "xyz":
        inside = inside & (F.col(f"n{a}") >= 0) & (F.col(f"n{a}") < top)
    there = morton.interleave(F.col("nx"), F.col("ny"), F.col("nz"))
    return out.where(inside).withColumn("there", there).drop(*(f"{k}{a}" for k in "jno" for a in "xyz"))


def adjacent(a: str, b: str):
    """Whether two cells of one level touch or are the same, by their coordinates (columns ax, bx, ...)."""
    out = F.lit(True)
    for x in "xyz":
        out = out & (F.abs(F.col(a + x) - F.col(b + x)) <= 1)
    return out


def uniform_cells(placed: DataFrame, depth: int) -> DataFrame:
    """cell_id, level, cell, n: occupied cells of every level, numbered by level, then cell."""
    finest = placed.groupBy("cell").agg(F.count("*").alias("n"))
    every = finest.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "cell", "n")
    up = every.withColumn("cell", F.call_function("shiftright", F.col("cell"), (3 * (depth - F.col("level"))).cast("int")))
    return with_rank(up.groupBy("level", "cell").agg(F.sum("n").alias("n")), ["level", "cell"], "cell_id")


def execution_view(placed: DataFrame, depth: int) -> DataFrame:
    """uniform_cells with parent, nth (place among the parent's children), n_children, first_child (children
    have consecutive ids; -1 at the finest level), lo and hi (the cell's points in order of their cells,
    inclusive), and level_start (id of its level's first cell)."""
    cells = keep(uniform_cells(placed, depth))
    up = cells.select((F.col("level") + 1).alias("level"), F.col("cell").alias("up"), F.col("cell_id").alias("parent"))
    rows = cells.withColumn("up", F.shiftright("cell", 3)).join(up, ["level", "up"], "left").withColumn("parent", F.coalesce("parent", F.lit(-1)))
    kids = rows.where("parent >= 0").groupBy(F.col("parent").alias("cell_id")).agg(F.count("*").alias("n_children"), F.min("cell_id").alias("first_child"))
    rows = rows.join(kids, "cell_id", "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "first_child": F.coalesce("first_child", F.lit(-1))})
    nth = kids.select(F.col("cell_id").alias("parent"), F.col("first_child").alias("eldest"))
    rows = rows.join(nth, "parent", "left").withColumn("nth", F.coalesce(F.col("cell_id") - F.col("eldest"), F.lit(-1)))
    finest = keep(cells.where(F.col("level") == depth).select("cell", "n", F.col("cell_id")))
    base = finest.agg(F.min("cell_id")).head()[0] or 0
    spans = keep(starts(finest.withColumn("rank", F.col("cell_id") - F.lit(base)), "rank", "n", "lo").select("cell", "lo", (F.col("lo") + F.col("n") - 1).alias("hi")))
    above = spans.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("cell", F.call_function("shiftright", F.col("cell"), (3 * (depth - F.col("level"))).cast("int")))
    ranges = above.groupBy("level", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    first = cells.groupBy("level").agg(F.min("cell_id").alias("level_start"))  # a row a level
    return rows.join(ranges, ["level", "cell"]).join(first, "level").select("cell_id", "level", "cell", "n", "parent", "nth", "n_children", "first_child", "lo", "hi", "level_start")


def dense_cells(placed: DataFrame, depth: int) -> DataFrame:
    """The same with empty cells too: ids are fixed by level and cell."""
    spark = placed.sparkSession
    every = spark.range(sum(8**x for x in range(depth + 1)))
    first = F.coalesce(*(F.when(F.col("id") >= (8**x - 1) // 7, x) for x in range(depth, -1, -1)))
    every = every.withColumn("level", first).select(F.col("id").alias("cell_id"), "level", (F.col("id") - F.floor((F.call_function("shiftleft", F.lit(1).cast("long"), (3 * F.col("level")).cast("int")) - 1) / 7)).cast("long").alias("cell"))
    held = uniform_cells(placed, depth).select("level", "cell", "n")
    return every.join(held, ["level", "cell"], "left").select("cell_id", "level", "cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def v_list(cells: DataFrame) -> DataFrame:
    """target and source cell ids: children of the parent and of its neighbours that don't touch the cell."""
    up = keep(with_axes(cells.where("level > 0").select("cell_id", F.col("level") - 1, "cell").toDF("cell_id", "plevel", "cell")).withColumn("up", F.shiftright("cell", 3)).drop("cell"))
    parents = up.select("plevel", "up").distinct()
    near = neighbours(parents, "up", "plevel").select("plevel", "up", "there").unionByName(parents.withColumn("there", F.col("up")))
    target = up.select(F.col("cell_id").alias("target"), "plevel", "up", *(F.col(f"j{a}").alias(f"t{a}") for a in "xyz"))
    source = up.select(F.col("cell_id").alias("source"), "plevel", F.col("up").alias("there"), *(F.col(f"j{a}").alias(f"s{a}") for a in "xyz"))
    return target.join(near, ["plevel", "up"]).join(source, ["plevel", "there"]).where(~adjacent("t", "s")).select("target", "source")


def u_list(cells: DataFrame, depth: int, with_self: bool = True) -> DataFrame:
    """target and source ids of occupied finest cells that touch."""
    leaf = cells.where((F.col("level") == depth) & (F.col("n") > 0))
    other = leaf.select(F.col("cell").alias("there"), F.col("cell_id").alias("source"))
    out = neighbours(leaf).join(other, "there").select(F.col("cell_id").alias("target"), "source")
    return out.unionByName(leaf.select(F.col("cell_id").alias("target"), F.col("cell_id").alias("source"))) if with_self else out


def adaptive_cells(placed: DataFrame, depth: int, leaf_size: int, balance: bool = False) -> DataFrame:
    """cell_id, level, cell, n, is_leaf: a cell is cut while it holds more than leaf_size points, down to depth.

    balance: neighbouring leaves differ by one level at most; a leaf is cut, empty children included, while a neighbour
    of its level has grandchildren.
    """
    every = keep(uniform_cells(placed, depth).drop("cell_id"))
    up = every.select((F.col("level") + 1).alias("level"), F.col("cell").alias("up"), F.col("n").alias("up_n"))
    cells = every.withColumn("up", F.shiftright("cell", 3)).join(up, ["level", "up"], "left").where((F.col("level") == 0) | (F.col("up_n") > leaf_size)).select("level", "cell")
    cells = keep(cells)
    for _ in range(depth if balance else 0):
        inner = cells.where("level > 0").select((F.col("level") - 1).alias("level"), F.shiftright("cell", 3).alias("cell")).distinct()
        grand = cells.where("level > 1").select((F.col("level") - 2).alias("level"), F.shiftright("cell", 6).alias("there")).distinct()
        leaf = cells.where(F.col("level") < depth).join(inner, ["level", "cell"], "left_anti")
        cut = neighbours(leaf).join(grand, ["level", "there"], "left_semi").select("level", "cell").distinct()
        kids = cut.select((F.col("level") + 1).alias("level"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda o: F.col("cell") * 8 + o)).alias("cell"))
        more = keep(cells.unionByName(kids).distinct())
        if more.count() == cells.count():
            break
        cells = more
    inner = cells.where("level > 0").select((F.col("level") - 1).alias("level"), F.shiftright("cell", 3).alias("cell"), F.lit(False).alias("is_leaf")).distinct()
    rows = cells.join(every, ["level", "cell"], "left").join(inner, ["level", "cell"], "left")
    rows = rows.select("level", "cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("is_leaf", F.lit(True)).alias("is_leaf"))
    return with_rank(rows, ["level", "cell"], "cell_id")


def near_list(cells: DataFrame) -> DataFrame:
    """target and source ids of leaves that touch, across levels, without themselves."""
    leaf = keep(cells.where("is_leaf").select("cell_id", "level", "cell"))
    up = leaf.select("cell_id", F.col("level").alias("own"), "cell", F.explode(F.expr("sequence(0, level)")).alias("level"))
    up = up.withColumn("cell", F.call_function("shiftright", F.col("cell"), (3 * (F.col("own") - F.col("level"))).cast("int")))
    other = leaf.select("level", F.col("cell").alias("there"), F.col("cell_id").alias("source"))
    direct = neighbours(up).join(other, ["level", "there"]).select(F.col("cell_id").alias("target"), "source", (F.col("level") < F.col("own")).alias("coarser"))
    back = direct.where("coarser").select(F.col("source").alias("target"), F.col("target").alias("source"))
    return direct.select("target", "source").unionByName(back).distinct()


def tiles(cells: DataFrame, width: int) -> DataFrame:
    """tile_id, cell_id, nth, n: leaves cut into tiles of at most `width` points, numbered leaf by leaf."""
    held = cells.where("is_leaf AND n > 0").select("cell_id", F.col("n").alias("total"))
    rows = held.select("cell_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / width).cast("long") - 1)).alias("nth"))
    return with_rank(rows.select("cell_id", "nth", F.least(F.lit(width).cast("long"), F.col("total") - F.col("nth") * width).alias("n")), ["cell_id", "nth"], "tile_id")


def tile_sources(tile_rows: DataFrame, near: DataFrame) -> DataFrame:
    """target and source tiles: those of near leaves and the other tiles of a tile's own leaf."""
    own = tile_rows.select("cell_id").distinct().select(F.col("cell_id").alias("target"), F.col("cell_id").alias("source"))
    t = tile_rows.select(F.col("tile_id").alias("target_tile"), F.col("cell_id").alias("target"))
    s = tile_rows.select(F.col("tile_id").alias("source_tile"), F.col("cell_id").alias("source"))
    return near.unionByName(own).join(t, "target").join(s, "source").where("target_tile <> source_tile").select("target_tile", "source_tile")

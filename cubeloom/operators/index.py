"""Entities in cells: keys, spanning boxes, updates, look-ups, region filters and the cell hierarchy.

An entity table has id, x, y, z and, for bounded ones, min_x..max_z (null for points); any other columns are carried
along. Nothing is indexed physically: cells are columns, region filters add a code range that prunes files sorted by
`cell`, and the exact predicate decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions import geom, keys
from cubeloom.plans import intervals

P = ("x", "y", "z")
LOW, HIGH = ("min_x", "min_y", "min_z"), ("max_x", "max_y", "max_z")


def with_cell(df: DataFrame, level: int, out: str = "cell") -> DataFrame:
    return df.withColumn(out, keys.cell_code("x", "y", "z", level))


def sorted_by_cell(df: DataFrame, level: int, parts: int) -> DataFrame:
    """Bulk load order: rows of near cells in one file, so readers skip files by the statistics of `cell`."""
    return with_cell(df, level).repartitionByRange(parts, "cell").sortWithinPartitions("cell")


def spanning_cells(df: DataFrame, level: int, grow: float = 0.0, out: str = "cell") -> DataFrame:
    """One row for each cell that an entity's closed box (or point), grown by `grow`, touches."""
    size, last = 1 << (keys.MAX_LEVEL - level), (1 << level) - 1
    bounded = "min_x" in df.columns
    for axis, low, high in zip(P, LOW, HIGH, strict=True):
        a, b = (F.coalesce(F.col(low), F.col(axis)), F.coalesce(F.col(high), F.col(axis))) if bounded else (F.col(axis), F.col(axis))
        first = F.greatest(F.lit(0), F.floor((a - grow) / size).cast("long"))
        stop = F.least(F.lit(last), F.floor((b + grow) / size).cast("long"))
        df = df.withColumn(f"_{axis}", F.explode(F.when(first <= stop, F.sequence(first, stop)).otherwise(F.array().cast("array<bigint>"))))
    return df.withColumn(out, keys.morton("_x", "_y", "_z")).drop("_x", "_y", "_z")


def should_span(size, cell_size, policy: str = "balanced", threshold: float = 0.5) -> Column:
    """Whether an entity spans cells: its size against the cell's, by policy."""
    factor = {"balanced": 1.0, "memory": 1.5, "performance": 0.5}[policy]
    return keys.col(size) > threshold * factor * keys.col(cell_size)


def upsert(df: DataFrame, changes: DataFrame) -> DataFrame:
    """df with the rows of changes in place of those of the same id."""
    return df.join(changes.select("id"), "id", "left_anti").unionByName(changes, allowMissingColumns=True)


def latest(df: DataFrame, order: str) -> DataFrame:
    """The last row of each id by `order`."""
    w = Window.partitionBy("id").orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def moved(df: DataFrame, to: DataFrame) -> DataFrame:
    """Entities at new positions (id, x, y, z); a box moves along with its entity. Unknown ids change nothing."""
    new = to.select("id", *(F.col(c).alias(f"_{c}") for c in P))
    out = df.join(new, "id", "left")
    for axis, low, high in zip(P, LOW, HIGH, strict=True):
        shift = F.coalesce(F.col(f"_{axis}") - F.col(axis), F.lit(0.0))
        for c in ((low, high) if "min_x" in df.columns else ()):
            out = out.withColumn(c, F.col(c) + shift)
    for axis in P:
        out = out.withColumn(axis, F.coalesce(F.col(f"_{axis}"), F.col(axis)))
    return out.select(*df.columns)


def remove(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti")


def fetch(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the ids (id, position), in the order of position; unknown ids are left out."""
    return df.join(ids, "id").orderBy("position")


def page(df: DataFrame, number: int, size: int, order: str = "id") -> DataFrame:
    return df.orderBy(order).offset(number * size).limit(size)


def _code_ranges(box: tuple[float, ...], level: int, column: str, most: int = 16) -> Column:
    runs = intervals.world_box_intervals(box, level, most)
    out = F.lit(False)
    for a, b in runs:
        out = out | F.col(column).between(a, b)
    return out


def in_box(df: DataFrame, box: tuple[float, ...], *, cell: str | None = None, level: int | None = None) -> DataFrame:
    """Entities in the closed box (min x, y, z, max x, y, z): points inside it, boxes that overlap it.

    With a stored cell column of points, code ranges that cover the box are added for pruning."""
    low, high = tuple(map(repr, map(float, box[:3]))), tuple(map(repr, map(float, box[3:])))
    point = geom.in_box(P, low, high)
    exact = f"CASE WHEN min_x IS NULL THEN {point} ELSE {geom.boxes_overlap(LOW, HIGH, low, high)} END" if "min_x" in df.columns else point
    df = df.where(F.expr(exact))
    return df.where(_code_ranges(box, level, cell)) if cell else df


def in_sphere(df: DataFrame, centre: tuple[float, float, float], radius: float) -> DataFrame:
    """Entities within the closed distance: of points, or of the nearest point of a box; with the column distance."""
    c = tuple(map(repr, map(float, centre)))
    d = geom.dist(P, c)
    if "min_x" in df.columns:
        d = f"CASE WHEN min_x IS NULL THEN {d} ELSE {geom.box_distance(c, LOW, HIGH)} END"
    box = tuple(v - radius for v in centre) + tuple(v + radius for v in centre)
    return in_box(df, box).withColumn("distance", F.expr(d)).where(F.col("distance") <= radius)


def nodes(df: DataFrame, level: int) -> DataFrame:
    """Non-empty cells of a level with their entities counted."""
    cells = spanning_cells(df, level) if "min_x" in df.columns else with_cell(df, level)
    return cells.groupBy("cell").agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "cell", "n")


def node_boxes(cells: DataFrame, level: int, column: str = "cell") -> DataFrame:
    """The cells' world boxes: corner and edge."""
    at, size = keys.morton_decode(column), float(1 << (keys.MAX_LEVEL - level))
    # a generator keeps the decoding out of the filters above: the optimizer would repeat it in every one of them
    out = cells.withColumn("_at", F.explode(F.array(at)))
    for axis, low, high in zip(P, LOW, HIGH, strict=True):
        out = out.withColumn(low, F.col("_at")[axis] * size).withColumn(high, F.col("_at")[axis] * size + size)
    return out.drop("_at")


def nodes_inside_box(cells: DataFrame, level: int, box) -> DataFrame:
    low, high = tuple(map(repr, map(float, box[:3]))), tuple(map(repr, map(float, box[3:])))
    return node_boxes(cells, level).where(F.expr(geom.box_inside(LOW, HIGH, low, high)))


def nodes_meeting_box(cells: DataFrame, level: int, box) -> DataFrame:
    """Cells that share more than a face with the box."""
    open_overlap = " AND ".join(f"{a} < {float(d)!r} AND {b} > {float(c)!r}" for a, b, c, d in zip(LOW, HIGH, box[:3], box[3:], strict=True))
    return node_boxes(cells, level).where(F.expr(open_overlap))


def nodes_inside_sphere(cells: DataFrame, level: int, centre, radius: float) -> DataFrame:
    """Cells of which all corners are in the closed sphere: the farthest corner decides."""
    far = " + ".join(f"greatest(abs({a} - {c!r}), abs({b} - {c!r})) * greatest(abs({a} - {c!r}), abs({b} - {c!r}))" for a, b, c in zip(LOW, HIGH, map(float, centre), strict=True))
    return node_boxes(cells, level).where(F.expr(f"sqrt({far}) <= {float(radius)!r}"))


def nodes_meeting_sphere(cells: DataFrame, level: int, centre, radius: float) -> DataFrame:
    c = tuple(map(repr, map(float, centre)))
    return node_boxes(cells, level).where(F.expr(f"{geom.box_distance(c, LOW, HIGH)} <= {float(radius)!r}"))


def enclosing(df: DataFrame, point: tuple[float, float, float], first: int, last: int) -> DataFrame:
    """(level, cell, n): the coarsest non-empty cell from level `first` down to `last` that holds the point."""
    found = None
    for level in range(first, last + 1):
        here = with_cell(df, level).where(F.col("cell") == keys.cell_code(*(F.lit(float(v)) for v in point), level))
        row = here.groupBy("cell").agg(F.count("*").alias("n")).select(F.lit(level).alias("level"), "cell", "n")
        found = row if found is None else found.unionByName(row)
    return found.orderBy("level").limit(1)


def lookup(df: DataFrame, point: tuple[float, float, float], level: int) -> DataFrame:
    """Entities in the cell of the point."""
    return with_cell(df, level).where(F.col("cell") == keys.cell_code(*(F.lit(float(v)) for v in point), level))


def leaves(levels: DataFrame) -> DataFrame:
    """Of cells (level, cell) those with no child among them."""
    parents = levels.select((F.col("level") - 1).alias("level"), F.shiftright("cell", 3).alias("cell")).distinct()
    return levels.join(parents, ["level", "cell"], "left_anti")


def adaptive_cells(df: DataFrame, capacity: int, first: int, last: int) -> DataFrame:
    """(id, level, cell): each point's leaf after splitting over-full cells from level `first` on.

    A cell over capacity is split, unless it is of the last level or all its points fall into one child. Points are
    counted once, in the finest cells; coarser counts are sums over that much smaller table."""
    fine = with_cell(df, last, "_fine")
    cells = fine.groupBy("_fine").agg(F.count("*").alias("_n"))
    counts = cells
    for level in range(first, last + 1):
        code = F.shiftright("_fine", 3 * (last - level))
        sums = cells.groupBy(code.alias(f"_c{level}")).agg(F.sum("_n").alias(f"_n{level}"))
        counts = counts.withColumn(f"_c{level}", code).join(sums, f"_c{level}")
    leaf = F.lit(last)
    for level in range(last - 1, first - 1, -1):
        stop = (F.col(f"_n{level}") <= capacity) | (F.col(f"_n{level + 1}") == F.col(f"_n{level}"))
        leaf = F.when(stop, F.lit(level)).otherwise(leaf)
    counts = counts.select("_fine", leaf.alias("level"))
    cell = F.call_function("shiftright", F.col("_fine"), (F.lit(last) - F.col("level")) * 3)
    return fine.join(counts, "_fine").select("id", "level", cell.alias("cell"))

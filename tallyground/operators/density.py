"""Density clustering (DBSCAN) on great-circle distance, on a grid.

The globe is cut into latitude bands and each band into columns so that two points of one cell are always
within ``eps``. That gives three shortcuts:

* a cell that holds ``min_samples`` points has only core points, without looking at any pair;
* the other cells hold fewer than ``min_samples`` points, so counting their neighbours compares each point of
  the table with a bounded number of others;
* all core points of a cell belong to one cluster, so clusters are components of a graph of cells.

Whether two cells are linked is decided on bounding boxes that are refined only where needed, never
by listing all pairs of two crowded cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyground.functions.geo import angles, haversine
from tallyground.operators.components import connected_components
from tallyground.settings import cut_lineage

NOISE = -1
# Cell height as a share of eps: below 1/sqrt(2), so that a cell's diagonal is shorter than eps.
CELL_SHARE = 0.7
# A refinement step cuts a crowded box into SPLIT × SPLIT; after the last step boxes are single points.
SPLIT = 4
LAST_LEVEL = 12
# Cells with at most this many core positions are cut into single points at once.
FEW_PLACES = 64
# Bounds on distances leave this much room for rounding; links themselves are decided on real points.
ROOM = 1e-9

CELL = ["kind", "band", "column"]


def _band_cosines(band: Column, height: float) -> tuple[Column, Column]:
    """Smallest and largest cosine of latitude within a band."""
    south = band * F.lit(height) - F.lit(math.pi / 2)
    north = F.least(south + F.lit(height), F.lit(math.pi / 2))
    at_south, at_north = F.greatest(F.cos(south), F.lit(0.0)), F.greatest(F.cos(north), F.lit(0.0))
    holds_equator = (south <= 0) & (north >= 0)
    return F.least(at_south, at_north), F.when(holds_equator, 1.0).otherwise(F.greatest(at_south, at_north))


def _columns_in_band(band: Column, height: float) -> Column:
    """Number of equal columns such that a column is at most one cell height wide on the ground."""
    _, widest = _band_cosines(band, height)
    return F.greatest(F.lit(1), F.ceil(F.lit(2 * math.pi) * widest / F.lit(height))).cast("bigint")


def grid_points(df: DataFrame, kind: Column, lat: str, lon: str, row_id: str, eps: float) -> DataFrame:
    """Distinct positions per kind with weight, smallest row id, radians, cell and place inside the cell."""
    height = CELL_SHARE * eps
    spots = df.groupBy(kind.alias("kind"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(
        F.count("*").alias("weight"), F.min(row_id).alias("point")
    )
    turn = (F.col("lam") + F.lit(math.pi)) / F.lit(2 * math.pi)
    return (
        spots.withColumns(angles("lat", "lon"))
        .withColumn("row_place", (F.col("phi") + F.lit(math.pi / 2)) / F.lit(height))
        .withColumn("band", F.floor("row_place"))
        .withColumn("columns", _columns_in_band(F.col("band"), height))
        .withColumn("column_place", turn * F.col("columns"))
        .withColumn("column", F.pmod(F.floor("column_place"), F.col("columns")))
        .withColumns(
            {
                "in_row": F.col("row_place") - F.floor("row_place"),
                "in_column": F.col("column_place") - F.floor("column_place"),
            }
        )
        .drop("row_place", "column_place", "columns")
    )


def _boxes(points: DataFrame, keys: list[str]) -> DataFrame:
    """Tight box per key with its outermost points. Equal ``places`` 1 means a single position."""
    def corner(phi: Column, lam: Column) -> Column:
        return F.struct(phi.alias("phi"), lam.alias("lam"))

    return points.groupBy(*keys).agg(
        F.count("*").alias("places"),
        F.min("phi").alias("south"),
        F.max("phi").alias("north"),
        F.min("lam").alias("west"),
        F.max("lam").alias("east"),
        F.array(
            corner(F.min("phi"), F.min_by("lam", "phi")),
            corner(F.max("phi"), F.max_by("lam", "phi")),
            corner(F.min_by("phi", "lam"), F.min("lam")),
            corner(F.max_by("phi", "lam"), F.max("lam")),
        ).alias("edge"),
    )


def _side(boxes: DataFrame, side: str, keys: list[str]) -> DataFrame:
    shape = ["places", "south", "north", "west", "east", "edge"]
    return boxes.select(*[F.col(name).alias(f"{side}_{name}") for name in [*keys, *shape]])


def _gap_too_wide(eps: float) -> Column:
    """True when even the closest points of the boxes a and b would be farther apart than eps."""
    def narrowest(side: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.cos(F.col(f"{side}_south")), F.cos(F.col(f"{side}_north"))))

    rows = F.greatest(F.lit(0.0), F.col("a_south") - F.col("b_north"), F.col("b_south") - F.col("a_north"))
    # Bring b to the turn that lies next to a, so that the date line is no border.
    middle = (F.col("a_west") + F.col("a_east") - F.col("b_west") - F.col("b_east")) / 2
    turn = F.round(middle / F.lit(2 * math.pi)) * F.lit(2 * math.pi)
    columns = F.greatest(
        F.lit(0.0), F.col("a_west") - F.col("b_east") - turn, F.col("b_west") + turn - F.col("a_east")
    )
    closest = F.pow(F.sin(rows / 2), F.lit(2.0)) + narrowest("a") * narrowest("b") * F.pow(
        F.sin(F.least(columns, F.lit(math.pi)) / 2), F.lit(2.0)
    )
    return closest > F.lit(math.sin(eps / 2) ** 2 * (1 + ROOM))


def _touch(eps: float) -> Column:
    """True when two of the outermost points are within eps; for single positions this is the whole test."""
    return F.exists(
        "a_edge",
        lambda p: F.exists("b_edge", lambda q: haversine(p["phi"], p["lam"], q["phi"], q["lam"]) <= F.lit(eps)),
    )


def _judge(pairs: DataFrame, eps: float) -> DataFrame:
    """Add ``linked`` and drop the pairs that cannot be within eps."""
    single = (F.col("a_places") == 1) & (F.col("b_places") == 1)
    return pairs.filter(~_gap_too_wide(eps)).withColumn("linked", _touch(eps)).filter(F.col("linked") | ~single)


def adjacent_cells(cells: DataFrame, eps: float) -> DataFrame:
    """Every occupied cell with each cell id that may hold a point within eps of it, itself included.

    Output: the cell's own key and ``near_band, near_column``. Ids are computed, not looked up.
    """
    height = CELL_SHARE * eps
    reach = math.ceil(1 / CELL_SHARE)
    band, column = F.col("band"), F.col("column")
    own_cos, _ = _band_cosines(band, height)
    near_cos, _ = _band_cosines(F.col("near_band"), height)
    # At a pole the cosine is zero and the reach is the whole band.
    stretch = F.try_divide(F.lit(math.sin(eps / 2) * (1 + ROOM)), F.sqrt(F.col("own_cos") * near_cos))
    widest = 2 * F.asin(F.least(F.lit(1.0), F.coalesce(stretch, F.lit(1.0))))
    width = F.lit(2 * math.pi) / _columns_in_band(band, height)
    near_columns = _columns_in_band(F.col("near_band"), height)
    near_width = F.lit(2 * math.pi) / near_columns
    first = F.floor((column * width - F.col("widest")) / near_width - F.lit(ROOM))
    last = F.floor(((column + 1) * width + F.col("widest")) / near_width + F.lit(ROOM))
    return (
        cells.select(*CELL)
        .withColumn("near_band", F.explode(F.sequence(F.greatest(band - reach, F.lit(0)), band + reach)))
        .withColumn("own_cos", own_cos)
        .withColumn("widest", widest)
        .withColumns({"near_columns": near_columns, "first": first, "last": last})
        .withColumn("last", F.least(F.col("last"), F.col("first") + F.col("near_columns") - 1))
        .withColumn("near_column", F.explode(F.sequence("first", "last")))
        .select(*CELL, "near_band", F.pmod("near_column", "near_columns").alias("near_column"))
    )


def _neighbour_pairs(few: DataFrame, others: DataFrame, eps: float, value: str) -> DataFrame:
    """Pairs ``kind, point, value`` of a point of ``few`` and a point of ``others`` within eps.

    ``few`` has fewer than min_samples positions per cell, so a point of ``others`` meets a bounded number
    of partners however crowded its own cell is; AQE splits such a cell over several tasks.
    """
    reach = adjacent_cells(few.select(*CELL).distinct(), eps)
    asking = few.select(*CELL, "point", "phi", "lam").join(reach, CELL).select(
        "kind", F.col("near_band").alias("band"), F.col("near_column").alias("column"),
        F.col("point"), F.col("phi").alias("own_phi"), F.col("lam").alias("own_lam"),
    )
    answering = others.select(*CELL, "phi", "lam", value)
    return asking.join(answering, CELL).filter(
        haversine(F.col("own_phi"), F.col("own_lam"), F.col("phi"), F.col("lam")) <= F.lit(eps)
    )


def neighbour_counts(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Points with ``is_core``, at least ``min_samples`` rows within eps, the point's own included, and ``neighbours``, the
    number of those rows for points that are not core. Core points are not counted out: that would list the pairs of
    crowded cells.
    """
    crowded = points.groupBy(*CELL).agg(F.sum("weight").alias("cell_weight"))
    # The sum per cell joins back on its own key; AQE splits a hot cell.
    sized = points.join(crowded, CELL)
    few = sized.filter(F.col("cell_weight") < min_samples)
    counted = (
        _neighbour_pairs(few, points, eps, "weight")
        .groupBy("kind", "point")
        .agg(F.sum("weight").alias("found"))
        .withColumn("is_core", F.col("found") >= min_samples)
        .withColumn("neighbours", F.when(~F.col("is_core"), F.col("found")))
        .drop("found")
    )
    many = sized.filter(F.col("cell_weight") >= min_samples).withColumns(
        {"is_core": F.lit(True), "neighbours": F.lit(None).cast("bigint")}
    )
    return many.unionByName(few.join(counted, ["kind", "point"])).drop("cell_weight")


def core_cells_linked(core: DataFrame, eps: float) -> DataFrame:
    """Edges ``u, v`` between the nodes of cells that have core points within eps of each other.

    ``core`` holds core points with the ``node`` of their cell. Pairs of neighbouring cells are
    judged on their boxes. An open pair is judged again on the parts of both, until a witness is found
    or every part is out of reach: single points in cells with few of them, else 4 × 4 parts of each box.
    """
    pair = ["a_node", "b_node"]
    boxes = _boxes(core, ["node", *CELL])
    reach = adjacent_cells(boxes, eps).join(boxes.select("node", *CELL), CELL).select(
        F.col("node").alias("a_node"), "kind", F.col("near_band").alias("band"), F.col("near_column").alias("column")
    )
    touching = reach.join(boxes.select(*CELL, F.col("node").alias("b_node")), CELL).filter("a_node < b_node")
    judged = _judge(
        touching.select(*pair).join(_side(boxes, "a", ["node"]), "a_node").join(_side(boxes, "b", ["node"]), "b_node"),
        eps,
    )
    judged = cut_lineage(judged.select(*pair, "linked").withColumns({"a_part": F.lit("0"), "b_part": F.lit("0")}))
    edges = judged.filter("linked").select(*pair)
    open_pairs = judged.filter("not linked")
    level = 0
    # One step past LAST_LEVEL every box is a single point, and a pair of points is never open.
    while level <= LAST_LEVEL and not judged.filter("not linked").isEmpty():
        parent, part = _part(level), _part(level + 1)
        level += 1
        busy = open_pairs.select(F.explode(F.array(*pair)).alias("node")).distinct()
        keys = ["node", "parent", "part"]
        pieces = _boxes(core.join(busy, "node", "left_semi").withColumns({"parent": parent, "part": part}), keys)
        a = _side(pieces, "a", keys)
        b = _side(pieces, "b", keys)
        judged = _judge(
            open_pairs.select(*pair, F.col("a_part").alias("a_parent"), F.col("b_part").alias("b_parent"))
            .join(a, ["a_node", "a_parent"])
            .join(b, ["b_node", "b_parent"]),
            eps,
        )
        judged = cut_lineage(judged.select(*pair, "a_part", "b_part", "linked"))
        found = judged.filter("linked").select(*pair).distinct()
        edges = edges.unionByName(found)
        open_pairs = judged.filter("not linked").join(found, pair, "left_anti")
    return edges.select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))


def _part(level: int) -> Column:
    """Name of the box a point lies in at a refinement level."""
    if level == 0:
        return F.lit("0")
    own = F.concat_ws("/", F.col("phi").cast("string"), F.col("lam").cast("string"))
    if level > LAST_LEVEL:
        return own
    grain = F.lit(float(SPLIT**level))
    part = F.concat_ws(
        "/",
        F.floor(F.col("in_row") * grain).cast("string"),
        F.floor(F.col("in_column") * grain).cast("string"),
    )
    return F.when(F.col("mates") <= FEW_PLACES, own).otherwise(part)


def core_points(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Points with at least ``min_samples`` rows within eps, with ``node``, the smallest core point of
    their cell, and ``mates``, the number of core positions there."""
    core = neighbour_counts(points, eps, min_samples).filter("is_core")
    nodes = core.groupBy(*CELL).agg(F.min("point").alias("node"), F.count("*").alias("mates"))
    return core.join(nodes, CELL)


def _numbers(clusters: DataFrame) -> DataFrame:
    """``cluster``, the place of every ``root`` within its kind, from 0.

    The roots are dealt by range, numbered within their part, and shifted by the sizes of the parts before; so a kind with
    very many clusters is not numbered in one task.
    """
    dealt = cut_lineage(clusters.repartitionByRange("kind", "root").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("kind", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("kind", "part").orderBy("root")) - 1
    shifted = dealt.join(sizes.select("kind", "part", before.alias("before")), ["kind", "part"])
    return shifted.select("kind", "root", (place + F.col("before")).cast("bigint").alias("cluster"))


def dbscan_labels(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``kind, point, cluster, is_core`` for every distinct position of ``grid_points``.

    Clusters are numbered per kind by their smallest core point. A border point belongs to the
    smallest cluster number among the core points in its reach. The rest is noise, -1.
    """
    core = cut_lineage(core_points(points, eps, min_samples))
    roots = connected_components(core_cells_linked(core, eps))
    nodes = core.select("kind", "node").distinct()
    rooted = nodes.join(roots, F.col("node") == F.col("u"), "left").select(
        "kind", "node", F.coalesce("root", "node").alias("root")
    )
    numbered = rooted.join(_numbers(rooted.select("kind", "root").distinct()), ["kind", "root"]).select("node", "cluster")
    rest = points.join(core.select("kind", "point"), ["kind", "point"], "left_anti")
    core = core.join(numbered, "node")
    claimed = (
        _neighbour_pairs(rest, core, eps, "cluster")
        .groupBy("kind", "point")
        .agg(F.min("cluster").alias("cluster"))
    )
    border = rest.select("kind", "point").join(claimed, ["kind", "point"], "left").select(
        "kind", "point", F.coalesce("cluster", F.lit(NOISE)).cast("bigint").alias("cluster"),
        F.lit(False).alias("is_core"),
    )
    return core.select("kind", "point", "cluster", F.lit(True).alias("is_core")).unionByName(border)


def dbscan_clusters(
    df: DataFrame,
    lat: str,
    lon: str,
    row_id: str,
    by: str | None = None,
    eps: float = 0.0001,
    min_samples: int = 20,
) -> DataFrame:
    """Rows with ``cluster``; every value of ``by`` is clustered on its own, all in one job.

    ``eps`` is in radians. Rows need valid coordinates and a ``row_id`` that is unique over the table. The
    distance joins across the date line and at the poles as the formula does.
    """
    if not 0 < eps < 0.4:
        raise ValueError("eps is an angle in radians between 0 and 0.4")
    df = df.drop("cluster")
    if by:
        df = df.filter(F.col(by).isNotNull())
    kind = F.col(by) if by else F.lit(0)
    points = cut_lineage(grid_points(df, kind, lat, lon, row_id, eps))
    labels = dbscan_labels(points, eps, min_samples)
    spots = points.select("kind", "point", "lat", "lon").join(labels, ["kind", "point"]).select(
        F.col("kind").alias("label_kind"), F.col("lat").alias("label_lat"), F.col("lon").alias("label_lon"), "cluster"
    )
    at_spot = (F.col(lat) == F.col("label_lat")) & (F.col(lon) == F.col("label_lon"))
    return df.join(spots, at_spot & (kind == F.col("label_kind"))).drop("label_kind", "label_lat", "label_lon")

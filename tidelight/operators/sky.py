"""Positional joins on the sphere.

Positions become unit vectors in cubic cells as wide as the chord of the search radius,
so poles and the RA wrap need no special case. Equal positions are collapsed before any
join: a group of copies is matched once, whatever its size; only the catalog rows of an aggregate
go to the join as they are, where each meets a bounded number of positions. Cell joins are left to the
adaptive skew split, which divides the points of a crowded cell over tasks; salting here
would replicate the catalog, whose rows are already repeated for the neighbouring cells.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import separation_sql
from ..session import cut_lineage
from .skew import join_small, split_join

CELL = ["_cx", "_cy", "_cz"]
SUB = ["_sx", "_sy", "_sz"]
#: Cells on a side of a tile that one task resolves, and the most positions it takes.
TILE, TILE_ROWS = 4096, 50_000
#: Cells of an aggregate: the least width, at which three numbers of 21 bits name a cell, and the most positions in
#: one that are compared with every catalog row near them.
LEAST_WIDTH, CROWD = 2.0**-19, 256


def _chord(radius_arcsec: float) -> float:
    return 2.0 * math.sin(math.radians(radius_arcsec / 3600.0) / 2.0)


def _width(radius_arcsec: float) -> float:
    # a hair wider than the chord, so that rounding never moves a neighbour two cells away
    return _chord(radius_arcsec) * (1 + 1e-9)


# unit vector of (ra, dec)
XYZ = {
    "x": "cos(radians(dec)) * cos(radians(ra))",
    "y": "cos(radians(dec)) * sin(radians(ra))",
    "z": "sin(radians(dec))",
}
# from a pair of positions to their separation
SEP = separation_sql("ra", "dec", "_ra", "_dec")
# squared chord from a position (_px, _py, _pz) to the nearest and to the farthest point of a box
BOX_NEAR = " + ".join(f"pow(greatest(_{a}0 - _p{a}, _p{a} - _{a}1, 0.0D), 2)" for a in "xyz")
BOX_FAR = " + ".join(f"pow(greatest(abs(_{a}0 - _p{a}), abs(_{a}1 - _p{a})), 2)" for a in "xyz")


def with_cell(df: DataFrame, radius_arcsec: float, names: Sequence[str] = CELL) -> DataFrame:
    """Adds the integer cell of each position, as wide as the chord of the radius."""
    width = _width(radius_arcsec)
    return df.selectExpr("*", *[f"floor(({e}) / {width!r}D) AS {n}" for n, e in zip(names, XYZ.values())])


def with_vector(df: DataFrame, prefix: str) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS {prefix}{a}" for a, e in XYZ.items()])


def with_neighbours(df: DataFrame, radius_arcsec: float, names: Sequence[str] = CELL) -> DataFrame:
    """One row per cell around each row's cell that the sphere passes through, its own included.

    Of the 27 cells about two fifths lie on the sphere; no position is in the others."""
    steps = ", ".join(
        f"struct({x} AS a, {y} AS b, {z} AS c)" for x, y, z in itertools.product((-1, 0, 1), repeat=3)
    )
    rest = [c for c in df.columns if c not in names]
    moved = [f"{n} + _off.{f} AS {n}" for n, f in zip(names, "abc")]
    return df.selectExpr("*", f"explode(array({steps})) AS _off").selectExpr(*rest, *moved).where(_on_sphere(names, _width(radius_arcsec)))


def _on_sphere(names: Sequence[str], width: float) -> str:
    # squared distance of the centre of the sphere to the nearest and to the farthest point of a cell
    near = " + ".join(f"pow(greatest({n}, -({n} + 1), 0) * {width!r}D, 2)" for n in names)
    far = " + ".join(f"pow(greatest(abs({n}), abs({n} + 1)) * {width!r}D, 2)" for n in names)
    return f"{near} <= 1.0D + 1e-12D AND {far} >= 1.0D - 1e-12D"


def _distinct_positions(df: DataFrame) -> DataFrame:
    return df.where(F.col("ra").isNotNull() & F.col("dec").isNotNull()).select("ra", "dec").distinct()


def nearest_in_cone(
    points: DataFrame,
    catalog: DataFrame,
    radius_arcsec: float,
    order: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Nearest catalog row within the (inclusive) radius, per distinct position of ``points``.

    ``points`` needs ra, dec; ``catalog`` needs ra, dec and the ``order`` columns that
    decide ties. Output: ra, dec, ``sep`` and the catalog columns prefixed ``m_``, one row
    per position, or per position and value of the catalog columns ``by``. Copies of a
    catalog position keep their first row only.

    Inside a cell the catalog is split once more into sub-cells. A position first picks the
    sub-cells that can hold its nearest row, by the bounds of their extents, and meets only
    the rows of those: crowded cells do not produce all pairs.
    """
    by = list(by)
    rows, boxes = catalog_parts(catalog, radius_arcsec, order, by)
    return nearest_of_parts(points, rows, boxes, radius_arcsec, order, by)


def catalog_parts(catalog: DataFrame, radius_arcsec: float, order: Sequence[str], by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What a cone join needs of a catalog: its rows by sub-cell, and the extents of the sub-cells in each
    cell they can be met from."""
    by = list(by)
    payload = [c for c in catalog.columns if c not in ("ra", "dec", *by)]
    first = catalog.where(F.col("ra").isNotNull() & F.col("dec").isNotNull()).groupBy("ra", "dec", *by).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("_m")
    )
    first = with_cell(with_cell(first, radius_arcsec), radius_arcsec / 8.0, SUB)
    first = with_vector(first, "_")
    boxes = first.groupBy(*CELL, *SUB, *by).agg(
        *[F.expr(f"{fn}(_{a}) AS _{a}{i}") for a in "xyz" for i, fn in enumerate(("min", "max"))],
    )
    rows = first.select(*SUB, *by, F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), "_m")
    return rows, with_neighbours(boxes, radius_arcsec)


def nearest_of_parts(
    points: DataFrame, rows: DataFrame, boxes: DataFrame, radius_arcsec: float, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """:func:`nearest_in_cone` on the two parts of a catalog."""
    by = list(by)
    payload = rows.schema["_m"].dataType.names
    pos = with_cell(_distinct_positions(points), radius_arcsec)
    pos = with_vector(pos, "_p")
    limit = (_chord(radius_arcsec) * (1 + 1e-7)) ** 2
    cand = split_join(pos, boxes, CELL).select(
        "ra", "dec", *by, *SUB, F.expr(f"{BOX_NEAR} AS _near"), F.expr(f"{BOX_FAR} AS _far")
    ).where(F.col("_near") <= limit)
    # one entry per sub-cell, and a neighbourhood has a fixed number of sub-cells
    best = cand.groupBy("ra", "dec", *by).agg(
        F.min("_far").alias("_best"), F.collect_list(F.struct("_near", *SUB)).alias("_boxes")
    )
    slack = F.col("_best") * (1 + 1e-7) + 1e-22
    best = best.select(
        "ra", "dec", *by,
        F.explode(F.filter("_boxes", lambda b: b["_near"] <= slack)).alias("_b"),
    ).select("ra", "dec", *by, *[F.col(f"_b.{c}").alias(c) for c in SUB])
    pairs = split_join(best, rows, [*SUB, *by])
    pairs = pairs.withColumn("sep", F.expr(SEP)).where(F.col("sep") <= radius_arcsec)
    key = F.struct(F.col("sep"), *[F.col(f"_m.{o}") for o in order])
    picked = pairs.groupBy("ra", "dec", *by).agg(
        F.min_by(F.struct("sep", "_ra", "_dec", "_m"), key).alias("_h")
    )
    return picked.select(
        "ra", "dec", *[F.col(c).alias(f"m_{c}") for c in by], F.col("_h.sep").alias("sep"),
        F.col("_h._ra").alias("m_ra"), F.col("_h._dec").alias("m_dec"),
        *[F.col(f"_h._m.{c}").alias(f"m_{c}") for c in payload],
    )


def cone_join(
    points: DataFrame, catalog: DataFrame, radius_arcsec: float, order: Sequence[str], how: str = "left"
) -> DataFrame:
    """``points`` with their nearest catalog row within the radius (NULL if none)."""
    hits = nearest_in_cone(points, catalog, radius_arcsec, order)
    return split_join(points, hits, ["ra", "dec"], how)


def cone_aggregate(
    points: DataFrame, catalog: DataFrame, radius_arcsec: float, value: str, by: Sequence[str] = (), crowd: int = CROWD
) -> DataFrame:
    """Per distinct position (and ``by``): catalog rows in the cone and their largest ``value``.

    The catalog is shuffled once, by cells two radii wide that one number names; only positions are repeated, for
    the few cells their cones reach. Positions in a cell of more than ``crowd`` go by :func:`_crowded_aggregate`,
    so that a catalog row never meets more than a fixed number of positions one by one.
    """
    by = list(by)
    width = max(2.0 * _width(radius_arcsec), LEAST_WIDTH)
    rows = _with_cell_number(catalog.where(F.col("ra").isNotNull() & F.col("dec").isNotNull()), width).select(
        "_cell", F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), *by, F.col(value).alias("_v")
    )
    pos = _with_cell_number(_distinct_positions(points), width)
    full = pos.groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select("_cell")
    if full.isEmpty():
        return _paired_aggregate(pos, rows, radius_arcsec, width, by)
    few = _paired_aggregate(split_join(pos, full, ["_cell"], "left_anti"), rows, radius_arcsec, width, by)
    return few.unionByName(_crowded_aggregate(split_join(pos, full, ["_cell"], "left_semi"), rows, radius_arcsec, width, by))


def _paired_aggregate(pos: DataFrame, rows: DataFrame, radius_arcsec: float, width: float, by: Sequence[str]) -> DataFrame:
    """:func:`cone_aggregate` by all pairs of a position and a row of the cells it reaches."""
    reached = _reached_cells(pos, radius_arcsec, width).select("_cell", "ra", "dec")
    pairs = split_join(rows, reached, ["_cell"]).where(f"{SEP} <= {radius_arcsec!r}D")
    return pairs.groupBy("ra", "dec", *by).agg(F.count("*").alias("n_in_cone"), F.max("_v").alias("max_value"))


def _crowded_aggregate(pos: DataFrame, rows: DataFrame, radius_arcsec: float, width: float, by: Sequence[str]) -> DataFrame:
    """:func:`cone_aggregate` where many positions are close together.

    Equal catalog positions are folded into one weighted row. Sub-cells that lie inside the
    cone count as a whole; only the rows of those cut by its edge are looked at one by one.
    """
    reached = _reached_cells(pos, radius_arcsec, width)
    met = join_small(rows, reached.select("_cell").distinct(), ["_cell"], "left_semi")
    # a struct is equal to another with NULL in the same place
    kind = F.struct(*by) if by else F.lit(True)
    folded = met.groupBy("_cell", F.col("_ra").alias("ra"), F.col("_dec").alias("dec"), kind.alias("_by")).agg(
        F.count("*").alias("_n"), F.max("_v").alias("_v")
    )
    key = ["_cell", *SUB, "_by"]
    folded = with_vector(with_cell(folded, radius_arcsec / 8.0, SUB), "_")
    boxes = folded.groupBy(*key).agg(
        *[F.expr(f"{fn}(_{a}) AS _{a}{i}") for a in "xyz" for i, fn in enumerate(("min", "max"))],
        F.sum("_n").alias("_n"), F.max("_v").alias("_v"),
    )
    cand = split_join(reached, boxes, ["_cell"]).select(
        "ra", "dec", *key, "_n", "_v", F.expr(f"{BOX_NEAR} AS _near"), F.expr(f"{BOX_FAR} AS _far")
    )
    limit = _chord(radius_arcsec) ** 2
    inner, outer = limit * (1 - 1e-7), limit * (1 + 1e-7)
    whole = cand.where(F.col("_far") < inner).select("ra", "dec", "_by", "_n", "_v")
    edge = cand.where((F.col("_far") >= inner) & (F.col("_near") <= outer)).select("ra", "dec", *key)
    members = folded.select(*key, F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), "_n", "_v")
    single = split_join(edge, members, key).where(f"{SEP} <= {radius_arcsec!r}D").select("ra", "dec", "_by", "_n", "_v")
    out = whole.unionByName(single).groupBy("ra", "dec", "_by").agg(F.sum("_n").alias("n_in_cone"), F.max("_v").alias("max_value"))
    return out.select("ra", "dec", *[F.col(f"_by.{c}").alias(c) for c in by], "n_in_cone", "max_value")


def _with_cell_number(df: DataFrame, width: float) -> DataFrame:
    return df.selectExpr("*", f"{_cell_number(*[f'floor(({e}) / {width!r}D)' for e in XYZ.values()])} AS _cell")


def _cell_number(x: str, y: str, z: str) -> str:
    # cells of LEAST_WIDTH or more are at most 2^19 away from the centre
    return f"((({x}) + 1048576L) * 2097152L + ({y}) + 1048576L) * 2097152L + ({z}) + 1048576L"


def _reached_cells(pos: DataFrame, radius_arcsec: float, width: float) -> DataFrame:
    """One row per cell of the sphere that the cone of a position reaches: ra, dec, its vector and ``_cell``."""
    # a hair more than the chord, so that rounding never takes a cell away
    reach = _chord(radius_arcsec) * (1 + 1e-7) + 1e-15
    df = with_vector(pos.select("ra", "dec"), "_p")
    for a in "xyz":
        ends = [f"floor((_p{a} {sign} {reach!r}D) / {width!r}D)" for sign in "-+"]
        df = df.selectExpr("*", f"explode(sequence({', '.join(ends)})) AS _c{a}")
    near = " + ".join(f"pow(greatest(_c{a} * {width!r}D - _p{a}, _p{a} - (_c{a} + 1) * {width!r}D, 0.0D), 2)" for a in "xyz")
    df = df.where(f"{near} <= {reach**2!r}D AND {_on_sphere(CELL, width)}")
    return df.selectExpr("ra", "dec", "_px", "_py", "_pz", f"{_cell_number(*CELL)} AS _cell")


def greedy_dedup(rows: DataFrame, radius_arcsec: float, order: str, label: str) -> DataFrame:
    """Order-dependent positional dedup.

    Going through the rows by ``order``, a row not yet used becomes a representative and
    uses up every row strictly within the radius. Output: the representatives with all
    their columns, ``labels`` (distinct labels of every row in the cone, in row order,
    joined by '|') and ``n_close``.

    See :func:`representatives` for how they are found; equal positions are represented by their
    first row.
    """
    pts = rows.where(F.col("ra").isNotNull() & F.col("dec").isNotNull())
    spots = pts.groupBy("ra", "dec").agg(F.min(order).alias("_o"))
    reps, _ = representatives(spots, radius_arcsec)
    if reps is None:
        return pts.limit(0).withColumn("labels", F.lit("")).withColumn("n_close", F.lit(0).cast("long"))

    # distinct (position, label) keeps its first row; then labels per representative
    tagged = with_cell(
        pts.groupBy("ra", "dec", label).agg(F.min(order).alias("_o"), F.count("*").alias("_n")),
        radius_arcsec,
    )
    close = _covered(tagged, reps, radius_arcsec)
    per_label = close.groupBy("_rep", label).agg(F.min("_o").alias("_o"), F.sum("_n").alias("_n"))
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", label))), lambda s: s[label]), "|"
    )
    labels = per_label.groupBy("_rep").agg(joined.alias("labels"), F.sum("_n").alias("n_close"))
    return split_join(rows, labels.withColumnRenamed("_rep", order), [order])


def representatives(spots: DataFrame, radius_arcsec: float, tile: int = TILE, most: int = TILE_ROWS) -> tuple[DataFrame | None, int]:
    """Representatives among distinct positions (ra, dec, _o), with their cells, and the rounds it took.

    A position is a representative if no earlier representative is strictly within the radius. Tiles of
    ``tile`` cells on a side are resolved at once, each in one task, as far as positions beyond its border do
    not matter: what depends on such a position stays open for the next round, in which tiles lie
    elsewhere. A tile of more than ``most`` positions goes by cells instead: the first of a cell and
    all cells around it has no earlier rival left. Every round ends with dropping what its
    representatives cover, and is cut with a checkpoint. The number of rounds grows with the tiles that a
    chain of neighbours crosses in order, not with its length.
    """
    open_ = cut_lineage(with_cell(spots.select("ra", "dec", "_o"), radius_arcsec))
    reps, rounds = None, 0
    while not open_.isEmpty():
        new, crowded = _resolve_tiles(open_, radius_arcsec, tile, rounds * (tile // 3), most)
        if crowded or new.isEmpty():
            new = cut_lineage(new.unionByName(_first_of_cells(open_, radius_arcsec)).dropDuplicates(["_o"]))
        reps, rounds = new if reps is None else reps.unionByName(new), rounds + 1
        covered = _covered(open_, new, radius_arcsec).select("ra", "dec").distinct()
        open_ = cut_lineage(split_join(open_, covered, ["ra", "dec"], "left_anti"))
    return reps, rounds


def _first_of_cells(open_: DataFrame, radius_arcsec: float) -> DataFrame:
    first = open_.groupBy(*CELL).agg(F.min("_o").alias("_o"))
    around = with_neighbours(first, radius_arcsec).groupBy(*CELL).agg(F.min("_o").alias("_lowest"))
    chosen = split_join(first, around, CELL).where(F.col("_o") == F.col("_lowest")).select("_o")
    return split_join(open_, chosen, ["_o"], "left_semi")


def _resolve_tiles(open_: DataFrame, radius_arcsec: float, tile: int, shift: int, most: int) -> tuple[DataFrame, bool]:
    """Representatives that the tiles of at most ``most`` positions can tell, and whether others were left out."""
    at = [f"floor(({c} + {{d}} + {shift}) / {tile}D)" for c in CELL]
    own = "struct(" + ", ".join(f"{e.format(d=0)} AS {n}" for e, n in zip(at, "abc")) + ")"
    near = ", ".join(
        "struct(" + ", ".join(f"{e.format(d=d)} AS {n}" for e, d, n in zip(at, ds, "abc")) + ")" for ds in itertools.product((-1, 0, 1), repeat=3))
    dealt = open_.selectExpr("*", f"{own} AS _own", f"explode(array_distinct(array({near}))) AS _tile")
    sizes = dealt.groupBy("_tile").agg(F.count("*").alias("_n"))
    few = cut_lineage(sizes.where(F.col("_n") <= most))
    crowded = few.count() < sizes.count()
    dealt = dealt.join(few.select("_tile"), "_tile").select("ra", "dec", "_o", *CELL, (F.col("_own") == F.col("_tile")).alias("_core"), "_tile")

    def run(df):
        df = df.sort_values("_o")
        ra, dec = np.radians(df["ra"].to_numpy()), np.radians(df["dec"].to_numpy())
        cells, core = df[CELL].to_numpy(), df["_core"].to_numpy()
        held: dict[tuple, list] = {}  # cell -> representatives and unknown positions
        chosen = []
        for i in range(len(df)):
            x, y, z = cells[i]
            covered, unknown = False, not core[i]
            for dx, dy, dz in itertools.product((-1, 0, 1), repeat=3):
                for j, is_rep in held.get((x + dx, y + dy, z + dz), ()):
                    if (is_rep or not unknown) and _separation(ra[i], dec[i], ra[j], dec[j]) < radius_arcsec:
                        covered, unknown = covered or is_rep, unknown or not is_rep
            if covered:
                continue
            held.setdefault((x, y, z), []).append((i, not unknown))
            if not unknown:
                chosen.append(i)
        return df.iloc[chosen][["ra", "dec", "_o", *CELL]]

    return cut_lineage(dealt.groupBy("_tile").applyInPandas(run, open_.select("ra", "dec", "_o", *CELL).schema)), crowded


def _separation(ra1, dec1, ra2, dec2) -> float:
    """Great-circle distance in arc seconds of positions in radians."""
    h = math.sin((dec2 - dec1) / 2.0) ** 2 + math.cos(dec1) * math.cos(dec2) * math.sin((ra2 - ra1) / 2.0) ** 2
    return math.degrees(2.0 * math.asin(min(1.0, math.sqrt(h)))) * 3600.0


def _covered(rows: DataFrame, reps: DataFrame, radius_arcsec: float) -> DataFrame:
    """Rows strictly within the radius of a representative, with its order as ``_rep``."""
    centres = with_neighbours(reps.select("ra", "dec", "_o", *CELL), radius_arcsec).select(
        *CELL, F.col("ra").alias("_ra"), F.col("dec").alias("_dec"), F.col("_o").alias("_rep")
    )
    near = split_join(rows, centres, CELL)
    return near.where(f"{SEP} < {radius_arcsec!r}D")

"""Spatial joins as equi-joins on grid cells.

Every geometry has a level, a grid whose cells are as large as its bounding box or larger, so it meets four cells at
most. It is listed in its cells on its own level and on those coarser ones that the other side has shapes of, so
one huge shape costs one more level. Two geometries meet on the coarser of their levels, in the one cell that
holds the lower left corner of the intersection of their boxes, so no pair comes twice. The exact predicate then decides.

What a side is like is one aggregate by size: it tells the levels, and whether the listed side is small enough, by
its bytes, to be broadcast. Else both sides are shuffled by cell. Cells that a sample shows to hold more than ``HOT`` rows of a
side are dealt in parts: its rows go to one part each, those of the other side to every part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as st

PREDICATES = ("intersects", "contains", "within", "covers", "coveredby", "equals", "touches", "crosses", "overlaps")
#: Bytes of a listed side that is broadcast, at most.
BROADCAST = 8 << 20
#: Rows of a side in a part of a cell, rows that are sampled to find crowded cells, and such cells at most (the most crowded).
HOT, SAMPLE, CROWDED = 100_000, 20_000, 1000
#: Above the first level, one in so many doublings of the cell is a level.
STEP = 3


def _boxed(df: DataFrame, geom: str) -> DataFrame:
    g = st.as_geom(df, geom)
    named = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), g.alias("_g"))
    box = F.struct(st.st_xmin("_g").alias("x0"), st.st_ymin("_g").alias("y0"), st.st_xmax("_g").alias("x1"), st.st_ymax("_g").alias("y1"))
    return named.select("_row", "_g", box.alias("_b")).where("_b.x0 IS NOT NULL")


def _size() -> Column:
    return F.greatest(F.col("_b.x1") - F.col("_b.x0"), F.col("_b.y1") - F.col("_b.y0"))


def _weight(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, or more."""
    if isinstance(kind, T.StructType):
        return sum((_weight(value[f.name], f.dataType) for f in kind), F.lit(16))
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 32
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(32).cast("long"), lambda acc, x: acc + _weight(x, kind.elementType)), F.lit(16))
    if isinstance(kind, T.MapType):
        return _weight(F.map_keys(value), T.ArrayType(kind.keyType)) + _weight(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(16)


@dataclass
class _Side:
    """Rows and bytes by binary exponent of their size, and the extent of the boxes."""

    rows: dict[int, int]
    bytes: dict[int, int]
    extent: tuple[float, float, float, float] | None

    @property
    def count(self) -> int:
        return sum(self.rows.values())

    def typical(self) -> float:
        """A size that nine in ten boxes don't exceed, or that holds a few typical points."""
        seen, size = 0, 0.0
        for e in sorted(self.rows):
            seen += self.rows[e]
            size = 2.0**e if e > _LEAST else 0.0
            if seen >= 0.9 * self.count:
                break
        x0, y0, x1, y1 = self.extent
        return max(size, 2 * math.sqrt((x1 - x0) * (y1 - y0) / self.count))


#: Exponent of boxes without a size.
_LEAST = -1074


def _exponent(cell: float) -> Column:
    e = F.ceil(F.log2(_size() / cell)).cast("int")
    return F.when(_size() > 0, F.greatest(F.lit(_LEAST + 1), e)).otherwise(_LEAST)


def _side(df: DataFrame) -> _Side:
    weight = _weight(F.col("_row"), df.schema["_row"].dataType) + 2 * _weight(F.col("_g"), df.schema["_g"].dataType) + 200
    found = df.groupBy(_exponent(1.0).alias("e")).agg(F.count("*").alias("n"), F.sum(weight).alias("b"), F.min("_b.x0").alias("x0"), F.min("_b.y0").alias("y0"), F.max("_b.x1").alias("x1"), F.max("_b.y1").alias("y1")).collect()
    extent = (min(r.x0 for r in found), min(r.y0 for r in found), max(r.x1 for r in found), max(r.y1 for r in found)) if found else None
    return _Side({r.e: r.n for r in found}, {r.e: r.b for r in found}, extent)


def _levels(side: _Side, cell: float) -> dict[int, int]:
    """Rows by level, where ``cell`` is the width of a cell of level 0 and sizes are known by exponent: never too low."""
    out: dict[int, int] = {}
    for e, n in side.rows.items():
        level = 0 if e == _LEAST else _stepped(math.ceil(e - math.log2(cell) - 1e-9))
        out[level] = out.get(level, 0) + n
    return out


def _stepped(doublings: int) -> int:
    return max(0, -(-doublings // STEP) * STEP)


def _listed(df: DataFrame, cell: float, other: list[int]) -> DataFrame:
    """Rows in their cells: ``_l`` is their level, ``_level``, ``_cx`` and ``_cy`` the cell. ``other``: levels of the other side."""
    # the exponents that the statistics know, so that levels agree with them
    doublings = F.ceil(_exponent(1.0) - math.log2(cell) - 1e-9)
    own = F.when(_size() > 0, F.greatest(F.lit(0), F.ceil(doublings / STEP).cast("int") * STEP)).otherwise(0)
    theirs = F.array(*[F.lit(x) for x in other]).cast("array<int>")
    leveled = df.withColumn("_l", own)
    levels = F.concat(F.when(F.exists(theirs, lambda x: x <= F.col("_l")), F.array("_l")).otherwise(F.array().cast("array<int>")), F.filter(theirs, lambda x: x > F.col("_l")))
    leveled = leveled.withColumn("_level", F.explode(levels)).withColumn("_w", F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level")))
    at = lambda c: F.floor(F.col(c) / F.col("_w")).cast("long")
    return leveled.withColumn("_cx", F.explode(F.sequence(at("_b.x0"), at("_b.x1")))).withColumn("_cy", F.explode(F.sequence(at("_b.y0"), at("_b.y1"))))


_CELL = ["_level", "_cx", "_cy"]


def _crowded(a: DataFrame, b: DataFrame, counts: tuple[int, int], cell: float, levels: tuple[list[int], list[int]], hot: int) -> DataFrame | None:
    """The cells with more than ``hot`` rows of a side, as a sample shows, and the parts for the rows of each side."""
    found = []
    for i, (df, n) in enumerate(zip((a, b), counts, strict=True)):
        share = min(1.0, SAMPLE / max(1, n))
        listed = _listed(df.select("_b").sample(share, 7) if share < 1 else df.select("_b"), cell, levels[1 - i])
        parts = F.ceil(F.count("*") / share / hot).cast("long")
        found.append(listed.groupBy(*_CELL).agg(parts.alias("_n")).where("_n > 1").select(*_CELL, *[F.col("_n") if i == j else F.lit(1).cast("long").alias("_n") for j in range(2)]).toDF(*_CELL, "_na", "_nb"))
    both = found[0].unionByName(found[1]).groupBy(*_CELL).agg(F.max("_na").alias("_na"), F.max("_nb").alias("_nb"))
    rows = both.orderBy(F.desc(F.greatest("_na", "_nb"))).limit(CROWDED).collect()
    return a.sparkSession.createDataFrame(rows, both.schema) if rows else None


def _parted(df: DataFrame, crowded: DataFrame | None, mine: str, theirs: str, names: tuple[str, str], salt: int) -> DataFrame:
    """One part of those for this side's rows (``names[0]``), and all of those for the other's (``names[1]``)."""
    own, other = (F.lit(salt if n == "_na" else 1).cast("long") for n in (mine, theirs))
    if crowded is not None:
        df = df.join(F.broadcast(crowded), _CELL, "left")  # of ``CROWDED`` rows at most
        own, other = own * F.coalesce(mine, F.lit(1)), other * F.coalesce(theirs, F.lit(1))
    picked = df.withColumn(names[0], F.pmod(F.xxhash64("_row"), own))
    return picked.withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))


def spatial_join(
    left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate: str = "intersects", how: str = "inner", cell: float | None = None, salt: int = 1,
    broadcast: int = BROADCAST, hot: int = HOT,
) -> DataFrame:
    """Rows of both sides whose geometries fulfil the predicate.

    ``how``: inner, left, left_semi or left_anti. ``cell``: side of the smallest cells; chosen from the
    boxes of both sides if not given. ``salt``: parts into which each cell of the left side is split, beside those
    of crowded cells. ``broadcast``: bytes of a listed side that is broadcast, at most. ``hot``: rows in a part of a
    cell, about. Null and empty geometries meet nothing. Columns of both sides are kept, the left ones first.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"predicate must be one of {PREDICATES}")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left, left_semi or left_anti")
    a, b = _boxed(left, left_geom), _boxed(right, right_geom)
    sides = _side(a), _side(b)
    if cell is None:
        cell = 2.0 ** math.ceil(math.log2(max((x.typical() for x in sides if x.count), default=0.0) or 1.0))
    rows = [_levels(x, cell) for x in sides]
    used = tuple(sorted(x) for x in rows)
    # a row is in four cells at most on each of the levels that the other side has, or on its own
    small = [4 * (1 + len(used[1 - i])) * sum(x.bytes.values()) <= broadcast for i, x in enumerate(sides)]
    x, y = _listed(a, cell, used[1]), _listed(b, cell, used[0])
    keys = list(_CELL)
    if not any(small):
        crowded = _crowded(a, b, (sides[0].count, sides[1].count), cell, used, hot) if max(4 * len(used[1 - i]) * s.count for i, s in enumerate(sides)) > hot else None
        if crowded is not None or salt > 1:
            x, y = _parted(x, crowded, "_na", "_nb", ("_sa", "_sb"), salt), _parted(y, crowded, "_nb", "_na", ("_sb", "_sa"), salt)
            keys += ["_sa", "_sb"]
    x = x.select(*[F.col(c).alias("a" + c) for c in ("_row", "_g", "_b", "_l")], *keys, "_w")
    y = y.select(*[F.col(c).alias("b" + c) for c in ("_row", "_g", "_b", "_l")], *keys)
    x, y = F.broadcast(x) if small[0] and not small[1] else x, F.broadcast(y) if small[1] else y
    corner_x, corner_y = F.greatest("a_b.x0", "b_b.x0"), F.greatest("a_b.y0", "b_b.y0")
    met = x.join(y, keys).where(
        (F.col("_level") == F.greatest("a_l", "b_l"))
        & (F.col("a_b.x0") <= F.col("b_b.x1")) & (F.col("b_b.x0") <= F.col("a_b.x1")) & (F.col("a_b.y0") <= F.col("b_b.y1")) & (F.col("b_b.y0") <= F.col("a_b.y1"))
        & (F.floor(corner_x / F.col("_w")) == F.col("_cx")) & (F.floor(corner_y / F.col("_w")) == F.col("_cy"))
    )
    met = met.where(F.call_function(f"st_{predicate}", F.col("a_g"), F.col("b_g")))
    left_columns = [F.col(f"a_row.`{c}`").alias(c) for c in left.columns]
    right_columns = [F.col(f"b_row.`{c}`").alias(c) for c in right.columns]
    if how == "inner":
        return met.select(*left_columns, *right_columns)
    # rows that are alike meet alike: two hashes of a row stand for it
    hashes = lambda row: [F.xxhash64(row).alias("_k1"), F.xxhash64(F.lit(1), row).alias("_k2")]
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("a_row"))
    if how == "left":
        alone = rows.select("a_row", *hashes(F.col("a_row"))).join(met.select(*hashes(F.col("a_row"))).distinct(), ["_k1", "_k2"], "left_anti")
        nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns]
        return met.select(*left_columns, *right_columns).unionAll(alone.select(*left_columns, *nothing))
    found = met.select(*hashes(F.col("a_row"))).distinct()
    return rows.select("a_row", *hashes(F.col("a_row"))).join(found, ["_k1", "_k2"], how).select(*left_columns)

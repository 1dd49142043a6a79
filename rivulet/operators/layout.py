"""Picture layouts: integer arithmetic, one row or struct for each tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASPECT_TOLERANCE = 0.001
MIN_SIDE = 8
MAX_TILES = 16


def _int(x: Column) -> Column:
    return F.floor(x).cast("int")


def even(x: Column) -> Column:
    """The even number at or above."""
    return x + F.pmod(x, F.lit(2))


def fit_pad(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """The picture inside the cell, its aspect kept: w, h, x, y."""
    wide = w * to_h > h * to_w
    same = F.abs(w / h - to_w / to_h) < ASPECT_TOLERANCE
    nw = F.when(same | wide, to_w).otherwise(_int(w * to_h / h))
    nh = F.when(same | ~wide, to_h).otherwise(_int(h * to_w / w))
    nw, nh = F.greatest(F.lit(MIN_SIDE), nw), F.greatest(F.lit(MIN_SIDE), nh)
    return F.struct(nw.cast("int").alias("w"), nh.cast("int").alias("h"), _int((to_w - nw) / 2).alias("x"), _int((to_h - nh) / 2).alias("y"))


def fit_crop(w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """The part of the picture, of even sides, that fills the cell: w, h, x, y."""
    wide = w * to_h > h * to_w
    same = F.abs(w / h - to_w / to_h) < ASPECT_TOLERANCE
    cw = F.when(same | ~wide, w).otherwise(even(_int(h * to_w / to_h)))
    ch = F.when(same | wide, h).otherwise(even(_int(w * to_h / to_w)))
    cw, ch = F.least(w, cw), F.least(h, ch)
    return F.struct(cw.cast("int").alias("w"), ch.cast("int").alias("h"), _int((w - cw) / 2).alias("x"), _int((h - ch) / 2).alias("y"))


def gallery(df: DataFrame, n: str, width: int, height: int) -> DataFrame:
    """Tiles of equal size: 1, halves (along the longer side), 2 x 2, 3 x 3, 4 x 4; at most 16."""
    count = F.least(F.col(n).cast("int"), F.lit(MAX_TILES))
    cols = F.when(count <= 1, 1).when(count == 2, 1 if width < height else 2).when(count <= 4, 2).when(count <= 9, 3).otherwise(4)
    rows = F.when(count <= 1, 1).when(count == 2, 2 if width < height else 1).when(count <= 4, 2).when(count <= 9, 3).otherwise(4)
    tiles = df.where(F.col(n) > 0).select("*", cols.alias("_cols"), rows.alias("_rows"), F.explode(F.sequence(F.lit(0), count - 1)).alias("tile"))
    w, h = _int(F.lit(width) / F.col("_cols")), _int(F.lit(height) / F.col("_rows"))
    return tiles.select(*df.columns, "tile", (F.pmod("tile", "_cols") * w).cast("int").alias("x"), (_int(F.col("tile") / F.col("_cols")) * h).cast("int").alias("y"), w.alias("w"), h.alias("h"))


def speaker(df: DataFrame, n: str, width: int, height: int, *, location: str = "right", interspace: int = 0) -> DataFrame:
    """A main tile (0) and cells beside it, at most 12; location left, right, top or bottom.

    Up to 4 cells stand in one line of 4, 6 in one of 6, 8 in two of 4, 12 in two of 6.
    """
    side = location in ("left", "right")
    long_, short = (height, width) if side else (width, height)
    count = F.least(F.col(n).cast("int"), F.lit(13))
    per = F.when(count <= 5, 4).when(count <= 7, 6).when(count <= 9, 4).otherwise(6)
    lines = F.when(count <= 7, 1).otherwise(2)
    cell_long, cell_short = _int(F.lit(long_) / per), _int(F.lit(short) / (per + lines))
    main = F.when(count == 1, F.lit(short)).otherwise(short - lines * cell_short)
    tiles = df.where(F.col(n) > 0).select("*", per.alias("_per"), cell_long.alias("_cl"), cell_short.alias("_cs"), main.cast("int").alias("_main"), F.explode(F.sequence(F.lit(0), count - 1)).alias("tile"))
    first = F.col("tile") == 0
    along = F.when(first, 0).otherwise(F.pmod(F.col("tile") - 1, F.col("_per")) * F.col("_cl")) + F.when(first, 0).otherwise(interspace)
    line = _int((F.col("tile") - 1) / F.col("_per"))
    ahead = location in ("left", "top")
    across = F.when(first, (short - F.col("_main")) if ahead else F.lit(0)).otherwise((F.lit(0) if ahead else F.col("_main")) + line * F.col("_cs") + interspace)
    size_long = F.when(first, F.lit(long_)).otherwise(F.col("_cl") - 2 * interspace)
    size_short = F.when(first, F.col("_main")).otherwise(F.col("_cs") - 2 * interspace)
    x, y, w, h = (across, along, size_short, size_long) if side else (along, across, size_long, size_short)
    return tiles.select(*df.columns, "tile", *[v.cast("int").alias(a) for a, v in zip("xywh", (x, y, w, h))])


def custom(df: DataFrame, n: str, positions: list[tuple[int, int, int, int]]) -> DataFrame:
    """Given tiles (x, y, w, h), as many as there are frames."""
    cells = F.array(*[F.struct(F.lit(k).alias("tile"), *[F.lit(v).alias(a) for a, v in zip("xywh", p)]) for k, p in enumerate(positions)])
    return df.select("*", F.explode(F.slice(cells, 1, F.greatest(F.lit(0), F.col(n).cast("int")))).alias("_t")).select(*df.columns, "_t.*")


def main_first(index: Column, main: int) -> Column:
    """Places when stream ``main`` moves to the front."""
    return F.when(index == main, 0).when(index < main, index + 1).otherwise(index)


def scaled(w: Column, h: Column, to_w: int, to_h: int) -> Column:
    """Sizes after scaling; -2 keeps the aspect with an even side."""
    if to_w == -2:
        return F.struct((F.round(w * to_h / h / 2) * 2).cast("int").alias("w"), F.lit(to_h).alias("h"))
    if to_h == -2:
        return F.struct(F.lit(to_w).alias("w"), (F.round(h * to_w / w / 2) * 2).cast("int").alias("h"))
    return F.struct(F.lit(to_w).alias("w"), F.lit(to_h).alias("h"))


def rotated(w: Column, h: Column, degrees: Column) -> Column:
    turned = F.pmod(degrees, F.lit(180)) == 90
    return F.struct(F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))

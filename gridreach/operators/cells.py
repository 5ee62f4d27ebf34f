"""Grid cells: district assignment, retention, contiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridreach.operators import ordered as o


def assign_district(cells: DataFrame, pieces: DataFrame, ratio: float = 0.2) -> DataFrame:
    """District with the largest overlap, the runner-up, an ambiguity flag and the uncovered area.

    pieces has (grid_id, district, area).  The two largest are picked with one
    aggregate: the areas of a cell's few districts are sorted inside the row.
    """
    per = pieces.groupBy("grid_id", "district").agg(F.sum("area").alias("area"))
    ranked = per.groupBy("grid_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("neg"), "district"))).alias("d"), F.sum("area").alias("total")
    )
    first, second = F.get("d", F.lit(0)), F.get("d", F.lit(1))
    out = cells.join(ranked, "grid_id", "left")
    a1, a2 = -first["neg"], F.coalesce(-second["neg"], F.lit(0.0))
    return out.select(
        *cells.columns, first["district"].alias("district"), second["district"].alias("second_district"), a2.alias("second_overlap_m2"),
        (a1 / F.col("land_area_m2") * 100).alias("district_overlap_pct"), (a2 / F.col("land_area_m2") * 100).alias("second_overlap_pct"),
        F.coalesce((a2 > 0) & (a2 / a1 >= ratio), F.lit(False)).alias("ambiguous_district"),
        (F.col("land_area_m2") - F.coalesce("total", F.lit(0.0))).alias("overlap_vs_land_diff_m2"),
    )


def retain_cells(cells: DataFrame, cell_area: float, threshold: float = 0.1, prefix: str = "GRID_") -> DataFrame:
    """Keep cells with at least `threshold` land and number them 0, 1, ... in (ix, iy) order."""
    kept = cells.withColumn("pct_in_study_area", F.col("land_area_m2") / cell_area * 100).where(F.col("pct_in_study_area") >= threshold * 100)
    numbered = o.row_index(kept, ["ix", "iy"], name="_n").drop("n_rows")
    return numbered.withColumn("cell_name", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), 5, "0"))).drop("_n")


def queen(cells: DataFrame, key: str = "grid_id") -> DataFrame:
    """Directed contiguity (src, dst): the up to eight neighbours of each cell by index."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    near = F.array(*[F.struct((F.col("ix") + i).alias("nx"), (F.col("iy") + j).alias("ny")) for i, j in steps])
    want = cells.select(F.col(key).alias("src"), F.inline(near))
    have = cells.select(F.col(key).alias("dst"), F.col("ix").alias("nx"), F.col("iy").alias("ny"))
    return want.join(have, ["nx", "ny"]).select("src", "dst")

"""Names of namespaces and places on a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths


def namespaces(files: DataFrame, path: str, root: str = ".") -> DataFrame:
    """(folder, name) of every folder: its last part (root for the topmost) as a type name; later ones of a name, by depth and path, are
    numbered from 2."""
    folder = F.col("folder")
    top = folder == "."
    folders = files.select(paths.cluster(F.col(path)).alias("folder")).distinct().withColumn("base", F.when(top, paths.camel(F.lit(root))).otherwise(paths.camel(folder)))
    order = Window.partitionBy("base").orderBy(F.when(top, 0).otherwise(F.size(F.split("folder", "/"))), "folder")
    n = F.row_number().over(order)
    return folders.withColumn("n", n).select("folder", F.when(F.col("n") > 1, F.concat("base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("name"))


def grid(rows: DataFrame, group: str, order: list[str], width: int) -> DataFrame:
    """rows with x, y, w, h: up to three columns in each group, boxes four high and a step apart."""
    own = Window.partitionBy(group)
    numbered = rows.withColumn("__n", F.row_number().over(own.orderBy(*order)) - 1).withColumn("__cols", F.least(F.lit(3), F.count("*").over(own)))
    w = F.greatest(F.lit(8), F.floor(F.lit(width - 2) / F.col("__cols")) - 1).cast("long")
    placed = numbered.withColumn("w", w).withColumn("h", F.lit(4).cast("long"))
    return placed.withColumn("x", (1 + F.col("__n") % F.col("__cols") * (F.col("w") + 1)).cast("long")).withColumn("y", (1 + F.floor(F.col("__n") / F.col("__cols")) * 5).cast("long")).drop("__n", "__cols")

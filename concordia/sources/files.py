"""File discovery and page geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of images.
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")


def discover(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """(path, stem, length) of files below root by suffix in either case; temporary files of editors, ~$, are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | F.lower(name).endswith(s)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(wanted & ~name.startswith("~$")).select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")


def safe_dpi(longest_points: Column) -> Column:
    """Resolution at which the longest side has 3300 pixels, from 72 to 300; 300 where the size is unknown."""
    dpi = F.floor(3300 / (longest_points / 72)).cast("int")
    return F.when(longest_points > 0, F.least(F.greatest(dpi, F.lit(72)), F.lit(300))).otherwise(F.lit(300))

"""The genre map: loading, building from the tag rules, and writing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.functions.genres import classify
from wavecrate.operators.catalog import map_changes, overlay

SCHEMA = "tag string, genre string"


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """Tag and genre from a JSON object of tag: genre; a map that can't be read is empty, so lookups give Unknown."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    pairs = F.explode(F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return text.select(pairs.alias("tag", "genre"))


def build_map(old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The map with every tag classified anew, and the histogram before and after, most used first."""
    new = old.select("tag", classify(F.col("tag"), F.col("genre")).alias("genre"))
    return new, map_changes(old, new).orderBy(F.desc("n_after"), "genre")


def change_counts(old: DataFrame, additions: DataFrame) -> DataFrame:
    """How many additions change an entry of the old map, and how many are new to it."""
    both = additions.join(old.select("tag", F.col("genre").alias("was")), "tag", "left")
    return both.agg(F.count_if(F.col("was").isNotNull() & (F.col("was") != F.col("genre"))).alias("changed"), F.count_if(F.col("was").isNull()).alias("added"))


def write_map(genre_map: DataFrame, additions: DataFrame, path: str) -> None:
    """The overlaid map in the order of its tags, a JSON object a line."""
    overlay(genre_map, additions, "tag").orderBy("tag").write.mode("overwrite").json(path)

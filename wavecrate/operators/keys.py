"""Musical keys from chroma by profile correlation, in array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrate.operators.catalog import pearson

# Profiles from the tonic up, the factor of minor, Camelot codes by pitch class, and the least sure score.
MAJOR = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.3, 0.0]
MINOR = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.3, 0.0]
MINOR_BIAS, SURE = 1.3, 0.50
CAMELOT_MAJOR = ("8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B")
CAMELOT_MINOR = ("5A", "12A", "7A", "2A", "9A", "4A", "11A", "6A", "1A", "8A", "3A", "10A")


def best_key(rows: DataFrame, item: str, chroma: str) -> DataFrame:
    """Key, confidence and confident of each chroma; of equal scores the lower pitch, then major. No variance gives null."""
    tried = rows.select(item, chroma, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("shift"))
    turned = F.concat(F.slice(chroma, F.col("shift") + 1, F.lit(12)), F.slice(chroma, F.lit(1), F.col("shift")))
    tried = tried.withColumn("turned", turned)
    literal = lambda p: F.array(*map(F.lit, p))
    scores = F.array(F.struct(pearson(F.col("turned"), literal(MAJOR)).alias("score"), F.lit(0).alias("mode")), F.struct((pearson(F.col("turned"), literal(MINOR)) * MINOR_BIAS).alias("score"), F.lit(1).alias("mode")))
    flat = tried.select(item, "shift", F.explode(scores).alias("s")).select(item, "shift", "s.mode", "s.score")
    best = flat.groupBy(item).agg(F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("worse"), "shift", "mode"))).alias("b"))
    code = F.when(F.col("b.mode") == 0, F.get(F.array(*map(F.lit, CAMELOT_MAJOR)), F.col("b.shift"))).otherwise(F.get(F.array(*map(F.lit, CAMELOT_MINOR)), F.col("b.shift")))
    score = -F.col("b.worse")
    return best.select(item, F.when(F.col("b").isNotNull(), code).alias("key"), (F.floor(score * 1000 + 0.5) / 1000).alias("confidence"), F.coalesce(score >= SURE, F.lit(False)).alias("confident"))

"""Result rows as text: cells, messages and translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.functions.names import signed_text


def translated(rows: DataFrame, key: str, texts: DataFrame, language: str) -> DataFrame:
    """The text of a key in a language, else in English, else the key itself. texts: lang, key, text."""
    pick = lambda lang, name: texts.filter(F.col("lang") == lang).select(F.col("key").alias("__k"), F.col("text").alias(name))
    out = rows.join(pick(language, "__own"), F.col(key) == F.col("__k"), "left").drop("__k")
    out = out.join(pick("en", "__english"), F.col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumn("text", F.coalesce("__own", "__english", key)).drop("__own", "__english")


def filled(template: Column, values: dict[str, Column]) -> Column:
    """{name} by its value; names without a value stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def described(result: str = "") -> Column:
    """What happened to a result row, a list of lines in a fixed order; lines that don't apply are left out."""
    c = lambda name: F.col(f"{result}.{name}" if result else name)
    lines = [
        F.when(c("error").isNotNull(), F.concat(F.lit("failed: "), c("error"))),
        F.when(F.size(c("name_changes")) > 0, F.concat(F.lit("name cleaned: "), F.array_join(c("name_changes"), ", "))),
        F.when(c("identified_as").isNotNull(), F.concat(F.lit("identified as "), c("identified_as"))),
        F.when(c("genre").isNotNull(), F.concat(F.lit("genre "), c("genre"), F.lit(" from "), c("genre_source"))),
        F.when(c("bpm").isNotNull(), F.concat(F.lit("tempo "), c("bpm").cast("string"), F.when(c("bpm_mode") == "dynamic", F.concat(F.lit(" ("), c("bpm_min").cast("string"), F.lit(" to "), c("bpm_max").cast("string"), F.lit(")"))).otherwise(""))),
        F.when(c("key").isNotNull(), F.concat(F.lit("key "), c("key"), F.when(c("key_confident"), "").otherwise(" (unsure)"))),
        F.when(c("gain_db") != 0, F.concat(F.lit("gain "), signed_text(c("gain_db")), F.lit(" dB"))),
    ]
    return F.filter(F.array(*lines), lambda x: x.isNotNull())

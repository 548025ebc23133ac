"""Relational operators over items, tags and genre maps: lookups, votes, specific picks, overlays, unique paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions import genres as G
from wavecrate.sources.tables import packed, unpacked


def mapped(items: DataFrame, tag: Column, genre_map: DataFrame) -> DataFrame:
    """The genre of an exact tag, Unknown without one. The optimizer broadcasts the map if its size allows."""
    m = genre_map.select(F.col("tag").alias("__tag"), F.col("genre"))
    return items.join(m, tag == F.col("__tag"), "left").drop("__tag").withColumn("genre", F.coalesce("genre", F.lit("Unknown")))


def without_blocked(items: DataFrame, tag: Column, blocked: DataFrame) -> DataFrame:
    """Items whose tag isn't in the blocklist."""
    return items.join(blocked.select(F.col("tag").alias("__tag")), G.tag_form(tag) == F.col("__tag"), "left_anti").filter(G.tag_form(tag) != "")


def overlay(base: DataFrame, additions: DataFrame, key: str) -> DataFrame:
    """U4: additions replace entries of the base with their key."""
    return base.join(additions.select(key), key, "left_anti").unionByName(additions)


def map_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tags of each genre before and after; genres that are gone count 0 after."""
    before = old.groupBy("genre").agg(F.count("*").alias("n_before"))
    after = new.groupBy("genre").agg(F.count("*").alias("n_after"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return after.join(before, "genre", "full").select("genre", zero("n_before"), zero("n_after"))


def known_genres(genre_map: DataFrame) -> DataFrame:
    """The different genres of a map and Unknown, in order."""
    return genre_map.select("genre").union(genre_map.sparkSession.createDataFrame([("Unknown",)], "genre string")).distinct().orderBy("genre")


def ranked_votes(releases: DataFrame, item: str, rank: str, tags: str) -> DataFrame:
    """A1: weights 1 / (1 + rank) summed by item and tag; a release counts a tag once. `first` is the tag's first place.

    Ranks count accepted releases only, so filter before ranking.
    """
    placed = releases.select(item, rank, F.posexplode(F.array_distinct(F.transform(tags, lambda t: F.trim(F.lower(t))))).alias("pos", "tag")).filter("tag <> ''")
    first = F.min(F.struct(F.col(rank).alias("r"), F.col("pos").alias("p"))).alias("first")
    weight = F.sum(F.lit(1.0) / (F.lit(1) + F.col(rank))).alias("weight")
    return placed.groupBy(item, "tag").agg(weight, first)


def specific_pick(tags: DataFrame, item: str, order: list[Column], genre_map: DataFrame, parents: DataFrame) -> DataFrame:
    """The first genre that isn't generic; its child instead, if the next such genre is one with enough of the votes; else the first generic.

    tags: item, tag, weight (null if unknown). Result: item, genre, tag.
    """
    known = tags.withColumn("tag", G.tag_form(F.col("tag"))).filter(~G.is_not_a_genre(F.col("tag"))).join(genre_map, "tag")
    known = known.withColumn("generic", G.is_generic(F.col("genre")))
    known = known.withColumn("k", F.row_number().over(Window.partitionBy(item, "generic").orderBy(*order)))
    pick = lambda which: F.max(F.when(which, F.struct("genre", "tag", "weight")))
    best, next_, vague = (~F.col("generic")) & (F.col("k") == 1), (~F.col("generic")) & (F.col("k") == 2), F.col("generic") & (F.col("k") == 1)
    rows = known.filter("k <= 2").groupBy(item).agg(pick(best).alias("best"), pick(next_).alias("next"), pick(vague).alias("vague"))
    rows = rows.join(parents.select(F.col("child").alias("__child"), F.col("parent").alias("__parent")), F.col("next.genre") == F.col("__child"), "left")
    weak = F.coalesce((F.col("best.weight") > 0) & (F.col("next.weight") / F.col("best.weight") < G.CHILD_MIN_SHARE), F.lit(False))
    child = F.coalesce(F.col("__parent") == F.col("best.genre"), F.lit(False)) & ~weak
    chosen = F.when(child, F.col("next")).otherwise(F.coalesce("best", "vague"))
    return rows.withColumn("chosen", chosen).select(item, "chosen.genre", "chosen.tag")


def vote_order(names: Column) -> Column:
    """O3: names of array<struct<kind int, name string, count double>> by kind, then most counted, then place."""
    placed = F.transform(names, lambda x, i: F.struct(x["kind"].alias("kind"), (-F.coalesce(x["count"], F.lit(0.0))).alias("c"), i.alias("i"), F.lower(x["name"]).alias("name")))
    return F.filter(F.transform(F.array_sort(placed), lambda x: x["name"]), lambda n: n != "")


def earliest_year(rows: DataFrame, key: str, year: Column) -> DataFrame:
    """A2, A3: the least plausible year of each key."""
    return rows.groupBy(key).agg(F.min(F.when(year.between(1900, 2100), year)).alias("year"))


def result_order(frame: DataFrame, column: str, row: str, descending: bool = False) -> DataFrame:
    """O1: by one column, strings in lower case, unknown tempo as -1 and unknown loudness as minus infinity; stable."""
    kind = frame.schema[column].dataType.simpleString()
    value = F.lower(F.coalesce(F.col(column), F.lit(""))) if kind == "string" else F.coalesce(F.col(column).cast("double"), F.lit(float("-inf") if column.startswith("loudness") else -1.0))
    return frame.orderBy(value.desc() if descending else value.asc(), row)


_NUMBERED = r"(?s)^(.+) \(([2-9]|[1-9][0-9]{1,8})\)$"


def _named(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows (root, path, k, place) of one root in order of place: the number that each path's k-th row takes, null for the path itself."""
    used, following, numbers = set(), {}, []
    for path in rows.sort_values(["place", "path", "k"])["path"]:
        number, name = None, path
        dot = path.rfind(".")
        stem, ext = (path[:dot], path[dot:]) if dot > 0 else (path, "")
        while name in used:
            number = following.get(path, 2)  # numbers below it are taken and stay so
            following[path], name = number + 1, f"{stem} ({number}){ext}"
        used.add(name)
        numbers.append(number)
    return rows.sort_values(["place", "path", "k"])[["path", "k"]].rename(columns={"k": "upto"}).assign(number=pd.array(numbers, "Int64"))


def unique_paths(paths: DataFrame, path: str, order: str) -> DataFrame:
    """A path that is free keeps its name, else it takes the first free one of ` (2)`, ` (3)`, ... before the extension, row by row in order.

    Most paths meet no name that another path's numbering can take: their k-th row has number k. Only where a numbered
    name itself is in the input, rows of one root (a path without its numbers) depend on one another. Those are named
    in order, but never more rows of a path than the largest such number of its root and one: from there on nothing is
    taken, and numbers follow one another.
    """
    rows = packed(paths, path=path, place=order)
    stem, ext = F.regexp_replace("path", r"(?s)(?<=.)\.[^.]*$", ""), F.regexp_extract("path", r"(?s)^.+(\.[^.]*)$", 1)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("place")))
    names = rows.groupBy("path", stem.alias("stem"), ext.alias("ext")).agg(F.count("*").alias("n"))
    names = names.withColumn("root", F.concat(F.regexp_replace("stem", r"(?s)(?<=.)(?: \((?:[2-9]|[1-9][0-9]{1,8})\))+$", ""), "ext"))
    child = names.filter(F.col("stem").rlike(_NUMBERED)).select("root", F.concat(F.regexp_replace("stem", _NUMBERED, "$1"), "ext").alias("parent"), F.regexp_extract("stem", _NUMBERED, 2).cast("long").alias("number"))
    child = child.join(names.select(F.col("path").alias("parent")), "parent", "left_semi").groupBy("root").agg(F.max("number").alias("most"))
    again = names.groupBy("root").agg(F.max("n").alias("n")).filter("n > 1").select("root")
    clash = names.join(child.join(again, "root"), "root").select("path", "root", (F.col("most") + 1).alias("most"))
    rows = rows.join(clash, "path", "left").withColumn("upto", F.least("k", "most"))
    few = rows.filter("k <= most").select("root", "path", "k", "place")
    found = few.groupBy("root").applyInPandas(lambda group: _named(group), "path string, upto int, number long")
    rows = rows.join(found, ["path", "upto"], "left")
    number = F.when(F.col("most").isNotNull(), F.col("number") + F.col("k") - F.col("upto")).otherwise(F.when(F.col("k") > 1, F.col("k").cast("long")))
    name = F.when(number.isNull(), F.col("path")).otherwise(F.concat(stem, F.lit(" ("), number.cast("string"), F.lit(")"), ext))
    return unpacked(rows.withColumn("unique_path", name), paths.columns, "unique_path")


def nearest(items: DataFrame, item: str, features: str, centroids: DataFrame, scale: list[float]) -> DataFrame:
    """The centroid with the least scaled squared distance, the first on a tie. centroids: place, name, center; a fixed few."""
    pairs = items.crossJoin(F.broadcast(centroids))
    parts = F.zip_with(F.zip_with(features, "center", lambda a, b: a - b), F.array(*map(F.lit, scale)), lambda d, s: (d / s) * (d / s))
    pairs = pairs.withColumn("distance", F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))
    best = F.min(F.struct("distance", "place", "name"))
    return pairs.groupBy(item).agg(best.alias("b")).select(item, F.col("b.name").alias("name"), F.col("b.distance").alias("distance"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; null without variance."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    centred = F.array(F.struct(F.transform(a, lambda v: v - mean(a)).alias("x"), F.transform(b, lambda v: v - mean(b)).alias("y")))

    def ratio(c: Column) -> Column:
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        spread = F.sqrt(dot(c["x"], c["x"]) * dot(c["y"], c["y"]))
        return F.when(spread > 0, dot(c["x"], c["y"]) / spread)

    return F.get(F.transform(centred, ratio), 0)

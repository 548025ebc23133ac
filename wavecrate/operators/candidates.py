"""Candidates for a name from a catalogue by an inverted index, as a search service gives them: eight a query.

A name's tokens are its pairs of letters (words stand between spaces), each with the number of its repetition, so that
shared tokens count as in a bag. The similarity of two texts is 2 * shared / all tokens; candidates are names whose
artist and title both reach LEAST. Two texts that similar share one of their rarest tokens: with n tokens, one of the
first n - ceil(n * LEAST / (2 - LEAST)) + 1 in order of frequency. Only those are indexed, and names meet where they share
one of the artist's and one of the title's, so neither a common token nor a common title brings all its names together.
The join is over different names; rows that repeat a name come in again by their CANDIDATES smallest ids. The catalogue is
read once and the queries twice; the names, and each column's different texts with their bags, are kept in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions import names as N
from wavecrate.operators.genre_sources import CANDIDATES
from wavecrate.sources.tables import kept, spread

LEAST = 0.4
NAMES_A_TASK = 200  # a few names are the work of many, as each meets all that share its tokens


def bag(text: Column) -> Column:
    """Tokens as strings `pair#repetition`."""
    words = F.filter(F.split(N.compare_form(text), r"\s+"), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit(" "), w, F.lit(" ")).substr(i.cast("int"), F.lit(2)))))
    ordered = F.sort_array(F.coalesce(grams, F.array().cast("array<string>")))
    return F.transform(ordered, lambda g, i: F.concat(g, F.lit("#"), (i - F.array_position(ordered, g) + 1).cast("string")))


def dice(shared: Column, a: Column, b: Column) -> Column:
    """2 * shared / (a + b); 0 for two empty bags."""
    return F.when(a + b > 0, shared * F.lit(2.0) / (a + b)).otherwise(0.0)


def _names(rows: DataFrame, id_: str) -> DataFrame:
    """Different names (artist, title) with the CANDIDATES smallest ids that have them."""
    named = rows.select(F.col(id_).alias("id"), F.coalesce("artist", F.lit("")).alias("artist"), F.coalesce("title", F.lit("")).alias("title"))
    spread = named.withColumn("k", F.row_number().over(Window.partitionBy("artist", "title", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id"))).filter(F.col("k") <= CANDIDATES)
    return spread.groupBy("artist", "title").agg(F.slice(F.array_sort(F.collect_list("id")), 1, CANDIDATES).alias("ids"))


def _texts(column: str, *names: DataFrame) -> DataFrame:
    """Each different text of a column with its bag and its rarest tokens, enough that any similar bag shares one of its own rarest."""
    texts = reduce(DataFrame.unionByName, [n.select(column) for n in names]).distinct()
    bags = kept(spread(texts, NAMES_A_TASK).withColumn(f"{column}_bag", bag(F.col(column))), "bags")
    tokens = bags.select(column, F.explode(f"{column}_bag").alias("token"))
    found = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("n")), "token")
    ranked = found.groupBy(column).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    keep = F.size("t") - F.ceil(F.size("t") * F.lit(LEAST / (2 - LEAST)) - F.lit(1e-9)).cast("int") + 1
    rare = ranked.select(column, F.transform(F.slice("t", F.lit(1), keep), lambda x: x["token"]).alias(f"{column}_rare"))
    return bags.join(rare, column)


def search(queries: DataFrame, catalogue: DataFrame, query: str, candidate: str) -> DataFrame:
    """query, place (from 0), candidate, cand_artist, cand_title and score of the best CANDIDATES of each query.

    queries: query, artist, title; catalogue: candidate, artist, title. Artist and title must both be similar, as the
    service's query asks for both; the score is twice the titles' similarity and the artists', ties go to the smaller
    candidate. Names without a letter or digit in artist or title find nothing.
    """
    # Kept, so that the tables are read once, and bags are made of different texts, never of rows.
    own, other = kept(_names(queries, query).drop("ids"), "names"), kept(_names(catalogue, candidate), "names")
    for column in ("artist", "title"):
        texts = kept(_texts(column, own, other), "texts")
        own, other = own.join(texts, column), other.join(texts, column)
    own, other = kept(own, "names"), kept(other, "names")
    tokens = lambda rows: spread(rows, NAMES_A_TASK).withColumn("a", F.explode("artist_rare")).withColumn("t", F.explode("title_rare"))
    left = tokens(own).select("artist", "title", "a", "t")
    right = tokens(other).select(F.col("artist").alias("cand_artist"), F.col("title").alias("cand_title"), "a", "t")
    met = left.join(right, ["a", "t"]).select("artist", "title", "cand_artist", "cand_title").distinct()
    theirs = other.select(F.col("artist").alias("cand_artist"), F.col("title").alias("cand_title"), F.col("artist_bag").alias("cand_artist_bag"), F.col("title_bag").alias("cand_title_bag"), "ids")
    full = met.join(own.select("artist", "title", "artist_bag", "title_bag"), ["artist", "title"]).join(theirs, ["cand_artist", "cand_title"])
    near = lambda c: dice(F.size(F.array_intersect(f"{c}_bag", f"cand_{c}_bag")), F.size(f"{c}_bag"), F.size(f"cand_{c}_bag"))
    full = full.withColumn("near_title", near("title")).withColumn("near_artist", near("artist")).filter((F.col("near_title") >= LEAST) & (F.col("near_artist") >= LEAST))
    scored = full.withColumn("score", F.col("near_title") * 2 + F.col("near_artist"))
    best = Window.partitionBy("artist", "title").orderBy(F.desc("score"), F.col("ids")[0])
    few = scored.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= CANDIDATES).withColumn("candidate", F.explode("ids"))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("artist", "title").orderBy(F.desc("score"), "candidate")) - 1).filter(F.col("place") < CANDIDATES)
    rows = queries.select(query, F.coalesce("artist", F.lit("")).alias("artist"), F.coalesce("title", F.lit("")).alias("title"))
    return rows.join(few, ["artist", "title"]).select(query, "place", F.col("candidate").alias(candidate), "cand_artist", "cand_title", "score")

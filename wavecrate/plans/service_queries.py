"""The genre chain of the services over replies that are composed from the tables, kept in a reply store and asked once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.functions import fuzzy
from wavecrate.functions import genres as G
from wavecrate.operators import catalog as C
from wavecrate.operators import genre_sources as S
from wavecrate.operators.resolve import resolve
from wavecrate.sources import reply_store
from wavecrate.sources.tables import kept, load, shared_path, spread

GENRES = (("house", "House"), ("tech house", "Tech House"), ("pop", "Pop"), ("hip hop", "Hip-Hop"), ("techno", "Techno"), ("rock", "Rock"))
STYLES, STYLE = ("House", "Tech House", "pop", "seen live", "Hip Hop", "no such tag", "#techno"), "l_suppkey % 7"
KINDS, KIND = ("house", "Pop", "hip hop", "rock"), "(l_suppkey + l_linenumber) % 4"
ITEMS_A_TASK = 20_000
ID = "00000000-0000-4000-8000-%012d"


def _case(number: str, values: tuple[str, ...]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Parts as tracks of their makers; every fourth is a remix by its brand."""
    part = spread(load(spark, d, "part"), ITEMS_A_TASK).select(F.col("p_partkey").alias("item"), "p_size", "p_name", "p_brand", F.expr("concat('Manufacturer#', p_size % 5 + 1)").alias("artist"), F.expr("concat(p_name, ' ', p_partkey, CASE WHEN p_partkey % 4 = 0 THEN concat(' (', p_brand, ' Remix)') ELSE '' END)").alias("track"))
    made = part.withColumn("split", fuzzy.core_and_remixer_udf(F.col("track"))).withColumns({"remixer": F.col("split.remixer"), "core": F.col("split.core")})
    return made.drop("split").withColumn("recording_id", F.expr(f"CASE WHEN item % 5 = 1 THEN format_string('{ID}', item) WHEN item % 5 = 3 THEN 'no id' END"))


def _composed(spark: SparkSession, d: str, items: DataFrame) -> dict[str, DataFrame]:
    """Each service's replies (key, body) as JSON, from lines, sizes and names."""
    key = S.reply_key(F.when(F.col("remixer") != "", F.col("remixer")).otherwise(F.col("artist")), F.when(F.col("remixer") != "", F.col("core")).otherwise(F.col("track")))
    lines = load(spark, d, "lineitem").filter("l_linenumber <= 2 and l_partkey % 3 = 0")
    lines = lines.withColumn("k", F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))).filter("k <= 6")
    result = F.expr(f"""struct(k, named_struct('title', concat(CASE WHEN l_quantity % 4 = 0 THEN 'Zzyx 0' WHEN remixer <> '' THEN concat(remixer, ' (2)') ELSE artist END, ' - X'), 'year', cast(1980 + cast(l_quantity as int) % 40 as string),
        'style', array({_case(STYLE, STYLES)}), 'genre', array({_case(KIND, KINDS)})) AS r)""")
    found = lines.join(items, F.col("l_partkey") == F.col("item")).groupBy("item", key.alias("key")).agg(F.array_sort(F.collect_list(result)).alias("r"))
    full = kept(found.select("item", "key", F.to_json(F.struct(F.transform("r", lambda x: x["r"]).alias("results"))).alias("body")), "composed")
    # A field search that finds nothing makes way for the free text.
    releases = full.withColumn("field", F.when(F.col("item") % 2 == 0, F.col("body")).otherwise('{"results":[]}'))
    plain = items.filter("remixer = ''").withColumn("key", S.reply_key(F.col("artist"), F.col("track")))
    return {
        "release field": releases.select("key", F.col("field").alias("body")),
        "release text": full.select("key", "body"),
        "dated": plain.filter("item % 2 = 0").select("key", F.expr("""concat('{"recordings":[{"title":"', track, '","first-release-date":"', 1975 + p_size, '-01"},{"title":"Zzyx","first-release-date":"1901"}]}')""").alias("body")),
        "recording": plain.filter("item % 5 = 1").select(F.col("recording_id").alias("key"), F.expr("""concat('{"genres":[{"name":"pop","count":', p_size, '},{"name":"techno","count":9}],"tags":[{"name":"tech house","count":99}]}')""").alias("body")),
        "track": plain.filter("item % 5 = 2").select("key", F.expr("""concat('{"track":{"toptags":{"tag":[{"name":"House","count":100},{"name":"tech house","count":', p_size % 20, '}]}}}')""").alias("body")),
        "artist": items.select(F.lower("artist").alias("key")).union(items.select(F.lower("p_brand"))).distinct().select("key", F.expr("""CASE WHEN key IN ('manufacturer#1', 'brand#12') THEN '{"toptags":{"tag":[{"name":"Rock","count":100},{"name":"pop","count":50}]}}' WHEN key LIKE '%#2%' THEN '{"toptags":{"tag":[{"name":"hip hop","count":100}]}}' ELSE '{"toptags":{"tag":[]}}' END""").alias("body")),
        "search": items.select(F.lower("artist").alias("key")).union(items.select(F.lower("p_brand"))).distinct().select("key", F.expr(f"""CASE WHEN key LIKE '%#3%' THEN concat('{{"artists":[{{"id":"', format_string('{ID}', 3), '","name":"', upper(key), '"}}]}}') ELSE concat('{{"artists":[{{"id":"', format_string('{ID}', 3), '","name":"Zzyx"}}]}}') END""").alias("body")),
        "record": spark.range(1).select(F.expr(f"format_string('{ID}', 3)").alias("key"), F.lit('{"genres":[{"name":"house","count":1}],"tags":[]}').alias("body")),
    }


def service_genres(spark: SparkSession, d: str) -> DataFrame:
    """R1, R2, R4, R5, S14, S15 and the store of T3: all services' stages, each only for what is open."""
    items = kept(_items(spark, d), "items")
    store = reply_store.ReplyStore(spark, shared_path(spark, "replies"))
    for service, replies in _composed(spark, d, items).items():
        store.ask(service, replies.select("key", F.lit("").alias("url")), reply_store.joined_in(replies.dropDuplicates(["key"])), F.length("body") > 2)
    genre_map, parents = spark.createDataFrame(GENRES, "tag string, genre string"), G.parents(spark)
    replies = S.Replies(*[store.replies(x) for x in ("release field", "release text", "dated", "recording", "track", "artist", "search", "record")])
    stages, dear = S.service_chain(
        F.col("remixer") != "",
        correction=lambda i: i.filter("item % 11 = 0").select("item", F.lit("Corrected").alias("genre")),
        tag=lambda i: C.mapped(i.select("item", F.when(F.col("p_size") % 2 == 0, "techno").alias("tag")), F.col("tag"), genre_map).select("item", "genre"),
        audio=lambda i: i.filter("item % 7 = 0").select("item", F.lit("By sound").alias("genre")),
        **S.service_stages("item", replies, genre_map, parents),
    )
    return resolve(items, "item", stages, dear)


QUERIES = {"service_genres": service_genres}

_PARENTS = "(VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in sorted(G.PARENTS.items())) + ") par(child, parent)"
ORACLE = {
    "service_genres": f"""
        WITH i AS (SELECT p_partkey AS item, p_size, p_name, p_brand, 'Manufacturer#' || (p_size % 5 + 1) AS artist, p_partkey % 4 = 0 AS remix FROM part),
        map AS (SELECT * FROM (VALUES {", ".join(map(str, GENRES))}) m(tag, genre)),
        l AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS k FROM lineitem WHERE l_linenumber <= 2 AND l_partkey % 3 = 0),
        a AS (SELECT l_partkey AS item, row_number() OVER (PARTITION BY l_partkey ORDER BY k) - 1 AS r, {_case(STYLE, STYLES)} AS t1, {_case(KIND, KINDS)} AS t2, 1980 + CAST(l_quantity AS INTEGER) % 40 AS year
              FROM l WHERE k <= 5 AND l_quantity % 4 <> 0),
        y AS (SELECT item, min(year) AS year FROM a GROUP BY item),
        t AS (SELECT item, r, 0 AS p, trim(lower(t1)) AS tag FROM a UNION ALL SELECT item, r, 1, trim(lower(t2)) FROM a WHERE trim(lower(t1)) <> trim(lower(t2))),
        v AS (SELECT item, tag, round(sum(1.0::DOUBLE / (1 + r)), 9) AS w, min((r, p)) AS first FROM t GROUP BY ALL),
        g AS (SELECT item, genre, w, genre IN ('Pop', 'Rock') AS generic, row_number() OVER (PARTITION BY item, genre IN ('Pop', 'Rock') ORDER BY w DESC, first) AS k FROM v JOIN map ON map.tag = ltrim(v.tag, '#')),
        b AS (SELECT item, max(genre) FILTER (NOT generic AND k = 1) AS best, max(w) FILTER (NOT generic AND k = 1) AS bw, max(genre) FILTER (NOT generic AND k = 2) AS nxt, max(w) FILTER (NOT generic AND k = 2) AS nw, max(genre) FILTER (generic AND k = 1) AS vague FROM g GROUP BY item),
        rel AS (SELECT b.item, CASE WHEN par.parent = best AND nw / bw >= 0.1 THEN nxt ELSE coalesce(best, vague) END AS genre FROM b LEFT JOIN {_PARENTS} ON par.child = nxt),
        era AS (SELECT rel.item, CASE WHEN genre = 'Hip-Hop' AND NOT remix AND least(year, CASE WHEN rel.item % 2 = 0 THEN 1975 + p_size END) < 2000 THEN 'Old School Hip-Hop' ELSE genre END AS genre FROM rel JOIN y USING (item) JOIN i USING (item)),
        s AS (SELECT i.*, era.genre AS released, CASE WHEN remix THEN lower(p_brand) ELSE lower(artist) END AS who FROM i LEFT JOIN era USING (item)),
        o AS (SELECT *, CASE WHEN who IN ('manufacturer#1', 'brand#12') THEN 'Rock' WHEN who LIKE '%#2%' THEN 'Hip-Hop' END AS top, CASE WHEN who LIKE '%#3%' THEN 'House' END AS record FROM s)
        SELECT item,
               CASE WHEN item % 11 = 0 THEN 'Corrected' WHEN released IS NOT NULL THEN released WHEN NOT remix AND item % 5 = 1 THEN 'Techno' WHEN NOT remix AND item % 5 = 2 THEN CASE WHEN p_size % 20 >= 10 THEN 'Tech House' ELSE 'House' END
                    WHEN top IS NOT NULL THEN top WHEN record IS NOT NULL THEN record WHEN p_size % 2 = 0 THEN 'Techno' WHEN item % 7 = 0 THEN 'By sound' ELSE 'Unknown' END AS genre,
               CASE WHEN item % 11 = 0 THEN 'correction' WHEN released IS NOT NULL THEN CASE WHEN remix THEN 'remix release' ELSE 'release' END WHEN NOT remix AND item % 5 = 1 THEN 'recording' WHEN NOT remix AND item % 5 = 2 THEN 'track''s top tags'
                    WHEN top IS NOT NULL THEN CASE WHEN remix THEN 'remixer''s top tags' ELSE 'artist''s top tags' END WHEN record IS NOT NULL THEN CASE WHEN remix THEN 'remixer''s record' ELSE 'artist''s record' END
                    WHEN p_size % 2 = 0 THEN 'file tag' WHEN item % 7 = 0 THEN 'audio' ELSE 'no match' END AS source
        FROM o""",
}

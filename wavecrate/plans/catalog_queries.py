"""Queries over parts, orders and line items that stand for catalogue items, releases and tags (see each docstring)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrate.functions import genres as G
from wavecrate.functions import names as N
from wavecrate.operators import catalog as C
from wavecrate.sources.tables import load, spread

LINES_A_TASK, NAMES_A_TASK = 200_000, 10_000
# A small map of our own over the part types and brands.
MAP = (("promo", "House"), ("economy", "Deep House"), ("small", "Hip-Hop"), ("medium", "Trap"), ("large", "Pop"))
WORDS = ("deep house", "hardcore", "rap hardcore", "ghetto house", "dub metal", "drum & bass", "happy hardcore", "tech house mix", "minimal", "hip-hop", "trance", "salsa")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _map(spark: SparkSession, rows=MAP) -> DataFrame:
    return spark.createDataFrame(list(rows), "tag string, genre string")


def map_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Part types as tags."""
    return C.mapped(load(spark, d, "part").select("p_partkey", "p_type"), F.lower(F.substring_index("p_type", " ", 1)), _map(spark)).select("p_partkey", "genre")


def blocklist_filter(spark: SparkSession, d: str) -> DataFrame:
    """Words of part names and one of four tags, without those on the blocklist."""
    tag = F.get(F.array(*map(F.lit, ("#Remix", "seen live", " Techno ", ""))), (F.col("p_partkey") % 4).cast("int"))
    items = load(spark, d, "part").select("p_partkey", tag.alias("tag"))
    blocked = spark.createDataFrame([(t,) for t in G.NOT_GENRES], "tag string")
    return C.without_blocked(items, F.col("tag"), blocked)


def blocklist_predicate(spark: SparkSession, d: str) -> DataFrame:
    """The same as a predicate, with the generic flag of mapped genres."""
    tag = F.get(F.array(*map(F.lit, ("#Remix", "seen live", " Techno ", ""))), (F.col("p_partkey") % 4).cast("int"))
    genre = F.get(F.array(*map(F.lit, ("Pop", "House", "Unknown"))), (F.col("p_partkey") % 3).cast("int"))
    return load(spark, d, "part").select("p_partkey", G.is_not_a_genre(tag).alias("blocked"), G.is_generic(genre).alias("generic"))


def rule_first_match(spark: SparkSession, d: str) -> DataFrame:
    """Composed tags through the ordered rules; the old genre is kept where no rule fits."""
    tag = F.get(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % len(WORDS)).cast("int"))
    return load(spark, d, "part").select("p_partkey", tag.alias("tag"), G.classify(tag, F.lit("Old")).alias("genre"))


def map_overlay(spark: SparkSession, d: str) -> DataFrame:
    additions = load(spark, d, "part").select(F.lower(F.substring_index("p_type", " ", 1)).alias("tag")).distinct().filter("tag in ('promo', 'standard')").withColumn("genre", F.lit("New"))
    return C.overlay(_map(spark), additions, "tag")


def histogram_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Parts by genre under the map and under the overlaid map."""
    parts = load(spark, d, "part").select("p_partkey", "p_type")
    tag = F.lower(F.substring_index("p_type", " ", 1))
    return C.map_changes(C.mapped(parts, tag, _map(spark)), C.mapped(parts, tag, map_overlay(spark, d)))


def known_genres(spark: SparkSession, d: str) -> DataFrame:
    return C.known_genres(map_overlay(spark, d))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """Lines as releases of their order: accepted if the quantity is over 5, ranked by line number; tags are type and brand."""
    lines = load(spark, d, "lineitem")
    tasks = max(1, -(-lines.count() // LINES_A_TASK))  # one number; tasks stay as large however many lines there are
    lines = lines.filter("l_quantity > 5").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").repartition(tasks, "l_orderkey")
    lines = lines.withColumn("rank", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1)
    part = load(spark, d, "part").select("p_partkey", F.array(F.substring_index("p_type", " ", 1), "p_brand").alias("tags"))
    tagged = lines.repartition(tasks, "l_partkey").join(part.repartition(tasks, "p_partkey"), lines["l_partkey"] == part["p_partkey"])
    return C.ranked_votes(tagged.repartition(tasks, "l_orderkey"), "l_orderkey", "rank", "tags")


def style_votes(spark: SparkSession, d: str) -> DataFrame:
    """Weights in millionths, rounded, as sums of thirds depend on their order."""
    return _votes(spark, d).select("l_orderkey", "tag", F.round(F.col("weight") * 1000).cast("long").alias("weight"))


def preferred_specific(spark: SparkSession, d: str) -> DataFrame:
    votes = _votes(spark, d).withColumn("weight", F.round("weight", 6))
    return C.specific_pick(votes, "l_orderkey", [F.desc("weight"), F.col("first"), F.col("tag")], _map(spark), G.parents(spark))


def vote_order(spark: SparkSession, d: str) -> DataFrame:
    """Two lists of counted names for each part, one count missing."""
    entry = lambda kind, name, count: F.struct(F.lit(kind).alias("kind"), name.alias("name"), count.alias("count"))
    size = F.col("p_size").cast("double")
    names = F.array(entry(1, F.col("p_brand"), size), entry(0, F.lit("Low"), F.lit(10.0)), entry(0, F.col("p_type"), size), entry(1, F.lit("None"), F.lit(None).cast("double")))
    return load(spark, d, "part").select("p_partkey", F.array_join(C.vote_order(names), "|").alias("names"))


def earliest_year(spark: SparkSession, d: str) -> DataFrame:
    """Order years over 100000 as release years of customers, and the lesser of two sources that may be unknown."""
    orders = load(spark, d, "orders").filter("o_totalprice > 100000")
    first = C.earliest_year(orders, "o_custkey", F.year("o_orderdate"))
    other = C.earliest_year(load(spark, d, "orders").filter("o_orderpriority like '1%'"), "o_custkey", F.year("o_orderdate")).withColumnRenamed("year", "other")
    both = first.join(other, "o_custkey", "full")
    return both.select("o_custkey", F.least("year", "other").alias("year"))


def era_split(spark: SparkSession, d: str) -> DataFrame:
    genre = F.when(F.col("o_orderkey") % 2 == 0, "Hip-Hop").otherwise("House")
    return load(spark, d, "orders").select("o_orderkey", G.era(genre, F.year("o_orderdate")).alias("genre"))


def _file_name() -> str:
    return "concat(p_brand, '_-_', p_name, CASE p_partkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' WHEN 2 THEN '' ELSE ' v1.0.Wav' END)"


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """Extension, stem, safe name and folder of composed names."""
    name = F.expr(_file_name())
    return load(spark, d, "part").select("p_partkey", N.stem(name).alias("stem"), N.extension(name).alias("extension"), N.safe_file_name(F.concat(name, F.lit("?:*"))).alias("safe"), N.folder_name(F.concat("p_brand", F.lit(" / x. "))).alias("folder"))


def clean_names(spark: SparkSession, d: str) -> DataFrame:
    """Composed stems with a site, a media label, a bitrate or a download id."""
    text = F.expr("concat(p_brand, '_-_', p_name, CASE p_partkey % 5 WHEN 0 THEN ' (320kbps)' WHEN 1 THEN ' [Official Video]' WHEN 2 THEN ' (my-site.com)' WHEN 3 THEN concat(' ', 100000 + p_partkey) ELSE ' (Live)' END)")
    text, keys = N.cleaned(text)
    part = spread(load(spark, d, "part").select("p_partkey", "p_brand", "p_name"), NAMES_A_TASK)
    return part.select("p_partkey", text.alias("cleaned"), F.array_join(keys, ",").alias("changes"))


def parse_names(spark: SparkSession, d: str) -> DataFrame:
    """Brand and name joined by one of the separators, or by none."""
    sep = F.get(F.array(*map(F.lit, (*N.SEPARATORS, ""))), (F.col("p_partkey") % 6).cast("int"))
    parts = N.parsed(F.concat("p_brand", sep, "p_name"))
    return load(spark, d, "part").select("p_partkey", parts["artist"].alias("artist"), parts["track"].alias("track"))


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Compare form, correction key, escaped query and release artist of composed names."""
    raw = F.expr("concat(p_brand, ' (2) - ', upper(p_name), '!')")
    return load(spark, d, "part").select("p_partkey", N.compare_form(raw).alias("compare"), N.correction_key(F.col("p_brand"), raw).alias("key"), N.query_escape(raw).alias("escaped"), N.release_artist(raw).alias("artist"), N.is_ascii(raw).alias("ascii"))


def text_filter_sort(spark: SparkSession, d: str) -> DataFrame:
    """Parts that hold `1` in brand or type, by type in lower case."""
    rows = load(spark, d, "part").filter(N.matches_filter(" 1 ", F.col("p_brand"), F.col("p_type"))).select("p_partkey", "p_type")
    return C.result_order(rows, "p_type", "p_partkey")


def unique_path(spark: SparkSession, d: str) -> DataFrame:
    """Part types as paths; those of every tenth part already end in a number."""
    path = F.expr("CASE WHEN p_partkey % 10 = 0 THEN concat(p_type, ' (3).mp3') ELSE concat(p_type, '.mp3') END")
    return C.unique_paths(load(spark, d, "part").select("p_partkey", path.alias("path")), "path", "p_partkey").select("p_partkey", "unique_path")


def feedback_validate(spark: SparkSession, d: str) -> DataFrame:
    """Documents as entries and labels as what they were corrected to: trimmed, clamped, entries without correction dropped."""
    rows = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id", "quality").withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"), "left")
    from wavecrate.sources.feedback import clamped

    return rows.select("doc_id", clamped(F.col("text")).alias("file"), clamped(F.col("quality").cast("string")).alias("corrected")).filter("corrected is not null").select("doc_id", F.md5(F.col("file").cast("binary")).alias("file"), "corrected")


def gain_projection(spark: SparkSession, d: str) -> DataFrame:
    """Prices as measured loudness, every fifth unmeasured."""
    measured = F.when(F.col("p_partkey") % 5 != 0, -F.col("p_size").cast("double") / 4)
    return load(spark, d, "part").select("p_partkey", N.half_up(N.gain_db(measured, -14.0), 2).alias("gain"))


def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The first four components of the vectors against six fixed centres."""
    centres = [(k, f"c{k}", [((k * 7 + j * 3) % 11 - 5) / 20.0 for j in range(4)]) for k in range(6)]
    table = spark.createDataFrame(centres, "place int, name string, center array<double>")
    rows = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).cast("array<double>").alias("f"))
    return C.nearest(rows, "vec_id", "f", table, [1.0, 0.5, 2.0, 1.0]).select("vec_id", "name")


def key_profile(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve components of the vectors as chroma."""
    from wavecrate.operators.keys import best_key

    rows = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 12).cast("array<double>").alias("chroma"))
    return best_key(rows, "vec_id", "chroma").select("vec_id", "key")


QUERIES = {
    f.__name__: f
    for f in (map_lookup, blocklist_filter, blocklist_predicate, rule_first_match, map_overlay, histogram_before_after, known_genres, style_votes, preferred_specific, vote_order, earliest_year, era_split, file_names, clean_names, parse_names, name_keys, text_filter_sort, unique_path, feedback_validate, gain_projection, nearest_centroid, key_profile)
}

_M = f"m(tag, genre) AS (VALUES {_values(MAP)})"
_OVER = f"{_M}, a AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS tag, 'New' AS genre FROM part WHERE lower(split_part(p_type, ' ', 1)) IN ('promo', 'standard')), o AS (SELECT * FROM m WHERE tag NOT IN (SELECT tag FROM a) UNION ALL SELECT * FROM a)"
_VOTES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS rnk FROM lineitem WHERE l_quantity > 5),
        t AS (SELECT l_orderkey, rnk, unnest([{'p': 0, 't': lower(split_part(p_type, ' ', 1))}, {'p': 1, 't': lower(p_brand)}]) AS x FROM l JOIN part ON p_partkey = l_partkey),
        v AS (SELECT l_orderkey, x.t AS tag, sum(1.0::DOUBLE / (1 + rnk)) AS weight, min((rnk, x.p)) AS first FROM t GROUP BY ALL)"""
_TAG4 = "['#Remix', 'seen live', ' Techno ', ''][p_partkey % 4 + 1]"
_RAW = "concat(p_brand, ' (2) - ', upper(p_name), '!')"
_DIST = " + ".join(f"pow((embedding[{j + 1}]::DOUBLE - c.center[{j + 1}]) / {s}, 2)" for j, s in enumerate((1.0, 0.5, 2.0, 1.0)))
ORACLE = {
    "map_lookup": f"WITH {_M} SELECT p_partkey, coalesce(genre, 'Unknown') AS genre FROM part LEFT JOIN m ON tag = lower(split_part(p_type, ' ', 1))",
    "blocklist_filter": f"""
        WITH t AS (SELECT p_partkey, {_TAG4} AS tag FROM part), n AS (SELECT *, regexp_replace(trim(lower(tag)), '^#', '') AS form FROM t), b(tag) AS (VALUES {_values([(x,) for x in sorted(G.NOT_GENRES)])})
        SELECT p_partkey, tag FROM n WHERE form <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.tag = form)""",
    "blocklist_predicate": "SELECT p_partkey, p_partkey % 4 <> 2 AS blocked, p_partkey % 3 <> 1 AS generic FROM part",
    "rule_first_match": f"SELECT p_partkey, [{', '.join(repr(w) for w in WORDS)}][p_partkey % {len(WORDS)} + 1] AS tag, ['Deep House', 'Hardcore', 'Hip-Hop', 'Ghetto House / Juke', 'Rock', 'Drum & Bass', 'Hardcore', 'Tech House', 'Minimal / Deep Tech', 'Hip-Hop', 'Trance', 'Old'][p_partkey % {len(WORDS)} + 1] AS genre FROM part",
    "map_overlay": f"WITH {_OVER} SELECT * FROM o",
    "histogram_before_after": f"""
        WITH {_OVER}, b AS (SELECT coalesce(m.genre, 'Unknown') AS genre, count(*) AS n FROM part LEFT JOIN m ON tag = lower(split_part(p_type, ' ', 1)) GROUP BY 1),
        f AS (SELECT coalesce(o.genre, 'Unknown') AS genre, count(*) AS n FROM part LEFT JOIN o ON tag = lower(split_part(p_type, ' ', 1)) GROUP BY 1)
        SELECT coalesce(b.genre, f.genre) AS genre, coalesce(b.n, 0) AS n_before, coalesce(f.n, 0) AS n_after FROM b FULL JOIN f ON b.genre = f.genre""",
    "known_genres": f"WITH {_OVER} SELECT genre FROM o UNION SELECT 'Unknown'",
    "style_votes": f"WITH {_VOTES} SELECT l_orderkey, tag, CAST(round(weight * 1000) AS BIGINT) AS weight FROM v",
    "preferred_specific": f"""
        WITH {_M}, {_VOTES}, k AS (SELECT l_orderkey, v.tag, round(weight, 6) AS weight, first, genre, genre IN ('Pop', 'Rock', 'Electronic', 'Unknown') AS g FROM v JOIN m ON m.tag = v.tag),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, g ORDER BY weight DESC, first, tag) AS n FROM k),
        s AS (SELECT l_orderkey, max(CASE WHEN NOT g AND n = 1 THEN genre END) AS bg, max(CASE WHEN NOT g AND n = 1 THEN tag END) AS bt, max(CASE WHEN NOT g AND n = 1 THEN weight END) AS bw,
                     max(CASE WHEN NOT g AND n = 2 THEN genre END) AS cg, max(CASE WHEN NOT g AND n = 2 THEN tag END) AS ct, max(CASE WHEN NOT g AND n = 2 THEN weight END) AS cw,
                     max(CASE WHEN g AND n = 1 THEN genre END) AS gg, max(CASE WHEN g AND n = 1 THEN tag END) AS gt FROM r GROUP BY l_orderkey),
        z AS (SELECT *, coalesce((cg = 'Deep House' AND bg = 'House') OR (cg = 'Trap' AND bg = 'Hip-Hop'), false) AND NOT coalesce(cw / bw < 0.1, false) AS child FROM s)
        SELECT l_orderkey, CASE WHEN child THEN cg ELSE coalesce(bg, gg) END AS genre, CASE WHEN child THEN ct ELSE coalesce(bt, gt) END AS tag FROM z""",
    "vote_order": """SELECT p_partkey, CASE WHEN p_size > 10 THEN lower(p_type) || '|low|' ELSE 'low|' || lower(p_type) || '|' END || lower(p_brand) || '|none' AS names FROM part""",
    "earliest_year": """
        WITH a AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders WHERE o_totalprice > 100000 GROUP BY 1), b AS (SELECT o_custkey, min(year(o_orderdate)) AS y FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
        SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CAST(least(a.y, b.y) AS INTEGER) AS year FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""",
    "era_split": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN 'House' WHEN year(o_orderdate) < 2000 THEN 'Old School Hip-Hop' ELSE 'Hip-Hop' END AS genre FROM orders",
    "file_names": f"""
        WITH n AS (SELECT p_partkey, p_brand, {_file_name()} AS name FROM part)
        SELECT p_partkey, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(regexp_extract(name, '\\.[^.]*$')) AS extension, regexp_replace(name, '[\\\\/:*?"<>|]', '', 'g') AS safe, concat(p_brand, ' & x') AS folder FROM n""",
    "clean_names": "SELECT p_partkey, concat(p_brand, ' - ', p_name, CASE p_partkey % 5 WHEN 4 THEN ' (Live)' ELSE '' END) AS cleaned, concat('clean.underscores', CASE p_partkey % 5 WHEN 0 THEN ',clean.bitrate' WHEN 1 THEN ',clean.mediaLabel' WHEN 2 THEN ',clean.site' WHEN 3 THEN ',clean.downloadId' ELSE '' END) AS changes FROM part",
    "parse_names": "SELECT p_partkey, CASE WHEN p_partkey % 6 < 5 THEN p_brand END AS artist, CASE WHEN p_partkey % 6 < 5 THEN trim(p_name) ELSE concat(p_brand, p_name) END AS track FROM part",
    "name_keys": f"""
        SELECT p_partkey, lower(regexp_replace({_RAW}, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) AS compare, concat(lower(regexp_replace(p_brand, '[^A-Za-z0-9_ ]', '', 'g')), ' ', regexp_replace(lower(regexp_replace({_RAW}, '[^A-Za-z0-9_ ]', '', 'g')), ' +', ' ', 'g')) AS key,
               regexp_replace({_RAW}, '([-+&|!(){{}}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped, p_brand AS artist, true AS ascii FROM part""",
    "text_filter_sort": "SELECT p_partkey, p_type FROM part WHERE contains(lower(concat_ws(' ', nullif(p_brand, ''), nullif(p_type, ''))), '1') ORDER BY lower(p_type), p_partkey",
    "unique_path": """
        WITH r AS (SELECT p_partkey, p_type, p_partkey % 10 = 0 AS lit, row_number() OVER (PARTITION BY p_type, p_partkey % 10 = 0 ORDER BY p_partkey) AS k FROM part),
        f AS (SELECT p_type AS t, min(CASE WHEN lit AND k = 1 THEN p_partkey END) AS literal, min(CASE WHEN NOT lit AND k = 3 THEN p_partkey END) AS third FROM r GROUP BY p_type),
        n AS (SELECT r.*, coalesce(third < literal, false) AS stolen, coalesce(literal < third, false) AS skipped FROM r JOIN f ON p_type = t)
        SELECT p_partkey, CASE WHEN lit AND k = 1 AND NOT stolen THEN p_type || ' (3).mp3' WHEN lit THEN p_type || ' (3) (' || (k + stolen::INT) || ').mp3' WHEN k = 1 THEN p_type || '.mp3'
               ELSE p_type || ' (' || (k + (skipped AND k >= 3)::INT) || ').mp3' END AS unique_path FROM n""",
    "feedback_validate": "SELECT d.doc_id, md5(left(trim(text), 500)) AS file, CAST(quality AS VARCHAR) AS corrected FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL",
    "gain_projection": "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN floor((-14.0::DOUBLE + p_size::DOUBLE / 4) * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END AS gain FROM part",
    "nearest_centroid": f"""
        WITH c AS (SELECT k, 'c' || k AS name, [((k * 7 + j * 3) % 11 - 5)::DOUBLE / 20.0::DOUBLE for j in [0, 1, 2, 3]] AS center FROM (SELECT unnest(range(6)) AS k))
        SELECT vec_id, name FROM embeddings, c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_DIST}, k) = 1""",
    "key_profile": """
        WITH c AS (SELECT vec_id, [x::DOUBLE for x in embedding[1:12]] AS ch FROM embeddings), s AS (SELECT unnest(range(12)) AS s),
        p AS (SELECT * FROM (VALUES (0, [1,0,0,0,1,0,0,1,0,0,0.3,0]::DOUBLE[], 1.0::DOUBLE), (1, [1,0,0,1,0,0,0,1,0,0,0.3,0]::DOUBLE[], 1.3::DOUBLE)) t(mode, prof, bias)),
        r AS (SELECT vec_id, s, mode, bias, prof, [ch[(i + s) % 12 + 1] for i in range(12)] AS rot FROM c, s, p),
        z AS (SELECT vec_id, s, mode, bias * list_inner_product([x - list_avg(rot) for x in rot], [y - list_avg(prof) for y in prof]) / sqrt(list_inner_product([x - list_avg(rot) for x in rot], [x - list_avg(rot) for x in rot]) * list_inner_product([y - list_avg(prof) for y in prof], [y - list_avg(prof) for y in prof])) AS score FROM r),
        b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, mode) = 1)
        SELECT vec_id, CASE WHEN mode = 0 THEN ['8B','3B','10B','5B','12B','7B','2B','9B','4B','11B','6B','1B'][s + 1] ELSE ['5A','12A','7A','2A','9A','4A','11A','6A','1A','8A','3A','10A'][s + 1] END AS key FROM b""",
}

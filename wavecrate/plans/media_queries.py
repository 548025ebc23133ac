"""Queries over composed names, bytes and generated signals. sound_analysis and sound_rendering have no SQL; tests hold
them to analytic values."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrate.functions import fuzzy, names
from wavecrate.operators import candidates
from wavecrate.operators import resolve as R
from wavecrate.sources import audio, lookups
from wavecrate.sources.tables import load, shared_path, spread

SOUNDS_A_TASK = 16  # bounds an Arrow batch, as a sound has half a megabyte or more
PAIRS_A_TASK = 5_000
SHORT_A_TASK = 64  # of six seconds, which never leave Python
RATE, PART, TURN, CELL, CLICK = 22_050, 1 << 14, 1 << 10, 64, 0.02  # of sounds that are made: samples made together, share of a beat that clicks


def similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """Part names against two variants of names nearby, through all gates."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    other = part.select((F.col("id") - 1).alias("near"), F.col("artist").alias("cand_artist"), F.concat("title", F.lit(" (Radio Edit)")).alias("cand_title"))
    own = part.select(F.col("id").alias("near"), F.upper("artist").alias("cand_artist"), F.concat(F.lit("The "), "title").alias("cand_title"))
    candidates = own.withColumn("place", F.lit(0)).unionByName(other.withColumn("place", F.lit(1)))
    return fuzzy.best_candidates(part.join(candidates, F.col("id") == F.col("near")), "id", "place").select("id", "place", "core_sim", "title_sim", "artist_sim")


def name_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name beside the next part's brand and name: where and how long their longest common run is, and how similar they are."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("own"), F.concat_ws(" ", "p_brand", "p_name").alias("other"))
    both = part.select("id", "own").join(part.select((F.col("id") - 1).alias("id"), "other"), "id")
    # Each different pair is compared once, however many parts share it. Neither name is ever null.
    pairs = spread(both.select("own", "other").distinct(), PAIRS_A_TASK)
    compared = pairs.select("own", "other", fuzzy.common_run_udf(F.col("own"), F.col("other")).alias("run"), fuzzy.similarity_udf(F.col("own"), F.col("other")).alias("sim"))
    return both.join(compared, ["own", "other"]).select("id", "run.own_start", "run.other_start", "run.size", "sim")


def transliterate(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("concat(p_name, ' Voina (club mix) ', p_brand)")
    return load(spark, d, "part").select("p_partkey", fuzzy.cyrillic_udf(text).alias("cyrillic"), fuzzy.ascii_udf(fuzzy.cyrillic_udf(text)).alias("back"), names.looks_transliterated(text).alias("marked"))


def split_titles(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' (DJ One Extended Remix)' WHEN 1 THEN ' - Live Version' ELSE ' feat. Other' END)")
    return load(spark, d, "part").select("p_partkey", fuzzy.core_udf(text).alias("core"), fuzzy.version_udf(text).alias("version"), fuzzy.remixer_udf(text).alias("remixer"), fuzzy.merged_udf(text, F.concat("p_name", F.lit(" (Remix)"))).alias("merged"))


def identify_chain(spark: SparkSession, d: str) -> DataFrame:
    """R3 over two replies' worth of candidates: songs first, then recordings, the second time in Cyrillic."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    one = part.filter("id % 3 = 0").select("id", F.lit(0).alias("place"), F.col("artist").alias("cand_artist"), F.col("title").alias("cand_title"))
    two = part.filter("id % 3 = 1").select("id", F.lit(0).alias("place"), fuzzy.cyrillic_udf(F.col("artist")).alias("cand_artist"), fuzzy.cyrillic_udf(F.col("title")).alias("cand_title"))
    return fuzzy.identified(part, [("songs", False, one), ("songs", True, two), ("recordings", False, one)], "id").select("id", "stage", "via_transliteration")


def candidate_search(spark: SparkSession, d: str) -> DataFrame:
    """Part names with slips of the pen against all parts: the eight nearest of each."""
    part = load(spark, d, "part").select(F.col("p_partkey").alias("candidate"), F.col("p_brand").alias("artist"), F.col("p_name").alias("title"))
    slips = part.select(F.col("candidate").alias("query"), F.upper("artist").alias("artist"), F.concat(F.translate("title", "e", "a"), F.lit(" mix")).alias("title"))
    found = candidates.search(slips, part, "query", "candidate")
    return found.select("query", F.col("place").cast("long").alias("place"), "candidate", F.floor(F.col("score") * 1_000_000).cast("long").alias("millionths"))


def tag_readers(spark: SparkSession, d: str) -> DataFrame:
    """ID3 bytes composed around brand and name."""

    @F.pandas_udf("binary")
    def made(artist: pd.Series, title: pd.Series) -> pd.Series:
        def file(a: str, t: str) -> bytes:
            frames = b"".join(struct.pack(">4sIH", n, len(v) + 1, 0) + b"\x03" + v for n, v in ((b"TPE1", a.encode()), (b"TIT2", t.encode()), (b"TCON", b"(17)")))
            size = len(frames)
            return b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + frames

        return pd.Series([file(a, t) for a, t in zip(artist, title, strict=True)])

    files = load(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(".mp3")).alias("name"), made("p_brand", "p_name").alias("content")).withColumn("length", F.octet_length("content"))
    return audio.with_tags(audio.with_state(files)).select("p_partkey", "state", "tags.genre", "tags.artist", "tags.title")


@lru_cache(maxsize=12)
def _turns(step: int) -> tuple[np.ndarray, np.ndarray]:
    """How three tones turn with each sample, and their sines and cosines (six rows) over TURN samples."""
    turns = 2 * np.pi * 261.63 * 2 ** ((step + np.array([0, 4, 7])) / 12) / RATE
    at = np.outer(turns, np.arange(TURN))
    return turns, np.concatenate([np.sin(at), np.cos(at)]) / 12


def _clicks(k: int, seconds: int, faster: bool) -> np.ndarray:
    """The samples of a sound that click. Beats never fall, so only cells that begin with a click or pass a whole beat are looked at."""

    def beats(at: np.ndarray) -> np.ndarray:
        t = at / RATE
        found = t * (100 + k % 5 * 10) / 60
        return found + np.maximum(0, t - seconds / 2) / 3 if faster and k % 2 else found

    cells = np.arange(0, seconds * RATE + CELL, CELL)
    edges = beats(cells)
    near = (edges % 1 < CLICK)[:-1] | (np.diff(np.floor(edges)) > 0)
    at = (cells[:-1][near][:, None] + np.arange(CELL)).ravel()
    at = at[at < seconds * RATE]
    return at[beats(at) % 1 < CLICK]


def _sound(k: int, seconds: int, faster: bool) -> bytes:
    """Clicks and a triad as a WAV file, made in parts: sin(a + b) = sin a cos b + cos a sin b, where a is a place every TURN samples."""
    from wavecrate.functions.loudness import wav_bytes

    (turns, table), out, clicks = _turns(k % 12), np.empty(seconds * RATE, np.float32), _clicks(k, seconds, faster)
    for lo in range(0, len(out), PART):
        at = np.outer(np.arange(lo, min(len(out), lo + PART), TURN), turns)
        tone = (np.concatenate([np.cos(at), np.sin(at)], 1) @ table).ravel()[: len(out) - lo]
        tone[clicks[np.searchsorted(clicks, lo) : np.searchsorted(clicks, lo + PART)] - lo] += 0.5
        out[lo : lo + PART] = tone
    return wav_bytes([out] * 2, RATE)


def _suppliers(spark: SparkSession, d: str, a_task: int) -> DataFrame:
    suppliers = load(spark, d, "supplier").select("s_suppkey")
    return suppliers.repartition(max(1, -(-suppliers.count() // a_task)))  # one number


def _made(seconds: int = 6, faster: bool = False) -> Column:
    """Each supplier's sound; a supplier without a key has none. faster: odd suppliers' clicks gain 20 a minute half way."""

    @F.pandas_udf("binary")
    def made(key: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(k) else _sound(int(k), seconds, faster) for k in key], dtype=object)

    return made.asNondeterministic()("s_suppkey")


def _sounds(spark: SparkSession, d: str) -> DataFrame:
    return _suppliers(spark, d, SOUNDS_A_TASK).select("s_suppkey", _made().alias("content"))


def sound_analysis(spark: SparkSession, d: str) -> DataFrame:
    """All measures of each sound, which goes from one function to the next inside its Python worker."""
    return _suppliers(spark, d, SHORT_A_TASK).select("s_suppkey", audio.analysis(_made(), True, True).alias("a")).select("s_suppkey", "a.*")


def sound_tempo(spark: SparkSession, d: str) -> DataFrame:
    """A minute for each supplier, so that windows tell a tempo that changes from one that doesn't; tempi to the nearest 5."""
    # A sound goes from one function to the next inside its Python worker, as it has five megabytes.
    found = _suppliers(spark, d, SOUNDS_A_TASK).select("s_suppkey", audio.analysis(_made(60, True), False, with_loudness=False).alias("a"))
    near = lambda c: (F.round(F.col(c) / 5) * 5).cast("int")
    return found.select("s_suppkey", F.col("a.bpm_mode").alias("mode"), near("a.bpm_min").alias("low"), near("a.bpm_max").alias("high"), "a.key")


def sound_rendering(spark: SparkSession, d: str) -> DataFrame:
    """Gain to -14, limiter, trim and resampling, then measured again."""
    first = _sounds(spark, d).withColumn("a", audio.analysis(F.col("content"), False, with_music=False))
    out = first.withColumn("wav", audio.rendered(F.col("content"), names.gain_db(F.col("a.short_term_max"), -14.0), True, 44_100))
    return out.withColumn("b", audio.analysis(F.col("wav"), True, with_music=False)).select("s_suppkey", F.octet_length("wav").alias("n_bytes"), F.col("a.short_term_max").alias("before"), F.col("b.short_term_max").alias("after"), F.col("b.true_peak").alias("true_peak"))


def lookup_replies(spark: SparkSession, d: str) -> DataFrame:
    """Composed JSON replies of a release search as accepted releases with their tags."""
    body = F.expr("""concat('{"results":[{"title":"', p_brand, ' (3) - X","year":"', 1990 + p_size, '","style":["', p_type, '"],"genre":["House"]}]}')""")
    rows = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), body.alias("body"))
    return lookups.releases(rows.filter("key % 2 = 0"), rows).select("key", "artist", "year", F.array_join("tags", "|").alias("tags"))


def resolve_chain(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tracks: corrected by an urgent priority, then styled by the first line's part, then tagged by status; remixes are every fourth."""
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    lines = load(spark, d, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    style = lines.join(load(spark, d, "part").filter("p_size > 25").select("p_partkey", "p_type"), F.col("p") == F.col("p_partkey"))
    remix = F.col("o_orderkey") % 4 == 0
    none = lambda items: items.select("o_orderkey", F.lit(None).cast("string").alias("genre"))
    stages = R.chain(
        remix, True,
        correction=lambda i: i.filter("o_orderpriority like '1%'").select("o_orderkey", F.lit("Corrected").alias("genre")),
        style=lambda i: i.join(style, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("p_type").alias("genre")),
        remixer_artist=none, recording=none, track=none,
        artist=lambda i: i.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("Artist").alias("genre")),
        tag=lambda i: i.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit("Tagged").alias("genre")),
        audio=none,
    )
    return R.resolve(orders, "o_orderkey", stages)


def stream_failures(spark: SparkSession, d: str) -> DataFrame:
    """T2 as a stream over the events table: failures of a user by day, run until the input ends.

    Each batch writes the windows that it changed to a table of its own number; the last number of a window counts.
    """
    from wavecrate.streaming.failures import failure_counts

    schema = load(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*events*").parquet(d.rstrip("/")).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = failure_counts(stream.filter("event_type = 'error'"), "user_id", "ts", "1 day", "1 day", "1 hour")
    path = shared_path(spark, "failures")

    def changed(rows: DataFrame, number: int) -> None:
        rows.select("user_id", F.unix_timestamp("window.start").alias("day"), "n", F.lit(number).alias("number")).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(changed).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("user_id", "day").agg(F.max_by("n", "number").alias("n"))


QUERIES = {f.__name__: f for f in (similar_titles, name_ratios, transliterate, split_titles, identify_chain, candidate_search, tag_readers, sound_analysis, sound_tempo, sound_rendering, lookup_replies, resolve_chain, stream_failures)}

# The letters as SQL has them, spelt here once more so that the query is held to them and not to its own tables.
_CYRILLIC = """MAP {
    'shch': 'щ', 'sch': 'щ', 'shh': 'щ', 'zh': 'ж', 'ch': 'ч', 'sh': 'ш', 'ia': 'я', 'ja': 'я', 'ya': 'я', 'iu': 'ю', 'ju': 'ю', 'yu': 'ю',
    'io': 'ё', 'jo': 'ё', 'yo': 'ё', 'ay': 'ай', 'oy': 'ой', 'ey': 'ей', 'uy': 'уй', 'iy': 'ий', 'yy': 'ый', 'je': 'е', 'kh': 'х', 'ts': 'ц',
    'jj': 'й', 'a': 'а', 'b': 'б', 'v': 'в', 'g': 'г', 'd': 'д', 'e': 'е', 'z': 'з', 'i': 'и', 'j': 'й', 'k': 'к', 'l': 'л',
    'm': 'м', 'n': 'н', 'o': 'о', 'p': 'п', 'r': 'р', 's': 'с', 't': 'т', 'u': 'у', 'f': 'ф', 'h': 'х', 'c': 'ц', 'y': 'ы'}"""
_LATIN = """MAP {
    'а': 'a', 'б': 'b', 'в': 'v', 'г': 'g', 'д': 'd', 'е': 'e', 'ё': 'e', 'ж': 'zh', 'з': 'z', 'и': 'i', 'й': 'i', 'к': 'k',
    'л': 'l', 'м': 'm', 'н': 'n', 'о': 'o', 'п': 'p', 'р': 'r', 'с': 's', 'т': 't', 'у': 'u', 'ф': 'f', 'х': 'kh', 'ц': 'ts',
    'ч': 'ch', 'ш': 'sh', 'щ': 'shch', 'ъ': '', 'ы': 'y', 'ь': '', 'э': 'e', 'ю': 'iu', 'я': 'ia'}"""
_GROUPS = "shch|sch|shh|zh|ch|sh|ia|ja|ya|iu|ju|yu|io|jo|yo|ay|oy|ey|uy|iy|yy|je|kh|ts|jj|[a-z]"


def _cyrillic_sql(text: str) -> str:
    """A name in Cyrillic: short i first, then the text in groups of letters, each by the table."""
    short = rf"regexp_replace(regexp_replace({text}, '([aeiouy])i([bcdfghjklmnpqrstvwxz])', '\1j\2', 'gi'), '([aeiouy])i\b', '\1j', 'gi')"
    cased = f"CASE WHEN x[1] = upper(x[1]) THEN upper(({_CYRILLIC})[lower(x)]) ELSE ({_CYRILLIC})[lower(x)] END"
    return f"array_to_string([coalesce({cased}, x) for x in regexp_extract_all({short}, '(?is){_GROUPS}|.')], '')"


_BACK = f"array_to_string([coalesce(CASE WHEN x = lower(x) THEN ({_LATIN})[x] ELSE upper(({_LATIN})[lower(x)][1:1]) || ({_LATIN})[lower(x)][2:] END, x) for x in string_split(cyrillic, '')], '')"
#: DuckDB, after pairs p (a, b, p): cells of equal letters, their runs along the diagonals, the longest run of what is left of each
#: pair in turn, and the ratio s.
_RATIOS = """
        x AS (SELECT p, b, a[i] AS letter, i FROM (SELECT p, a, b, unnest(range(1, len(a) + 1)) AS i FROM p)),
        cell AS (SELECT p, i, j FROM (SELECT p, b, letter, i, unnest(range(1, len(b) + 1)) AS j FROM x) WHERE letter = b[j]),
        island AS (SELECT p, i, j, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS island FROM cell),
        run AS (SELECT p, i, j, count(*) OVER (PARTITION BY p, i - j, island ORDER BY i DESC) AS k FROM island),
        rest AS (
            SELECT p, CAST(1 AS BIGINT) AS a0, len(a) + 1 AS a1, CAST(1 AS BIGINT) AS b0, len(b) + 1 AS b1, CAST(0 AS BIGINT) AS n FROM p
            UNION ALL
            SELECT p, unnest([a0, m[1] - m[2]]), unnest([-m[2], a1]), unnest([b0, m[1] - m[3]]), unnest([-m[3], b1]), unnest([m[1], 0])
            FROM (SELECT rest.p, a0, a1, b0, b1, max([least(k, a1 - i, b1 - j), -i, -j]) AS m FROM rest JOIN run ON run.p = rest.p AND i >= a0 AND i < a1 AND j >= b0 AND j < b1 GROUP BY ALL)),
        s AS (SELECT a, b, 2.0::DOUBLE * sum(n) / (len(a) + len(b)) AS s FROM rest JOIN p ON p.p = rest.p GROUP BY a, b)"""

ORACLE = {
    "transliterate": f"""
        WITH c AS (SELECT p_partkey, p_name, p_brand, {_cyrillic_sql("p_name || ' Voina '")} || '(club mix)' || {_cyrillic_sql("' ' || p_brand")} AS cyrillic FROM part)
        SELECT p_partkey, cyrillic, {_BACK} AS back, regexp_matches(p_name || ' Voina (club mix) ' || p_brand, '{names.TRANSLIT_MARKERS}', 'i') AS marked FROM c""",
    "split_titles": """
        WITH v AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN '(DJ One Extended Remix)' WHEN 1 THEN '(Live Version)' ELSE '(feat. Other)' END AS version FROM part)
        SELECT p_partkey, p_name AS core, version, CASE WHEN p_partkey % 3 = 0 THEN 'DJ One Extended' ELSE '' END AS remixer, p_name || ' ' || version AS merged FROM v""",
    "identify_chain": "SELECT p_partkey AS id, 'songs' AS stage, p_partkey % 3 = 1 AS via_transliteration FROM part WHERE p_partkey % 3 < 2",
    "name_ratios": f"""
        WITH RECURSIVE w AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS own, p_brand || ' ' || p_name AS other FROM part),
        c AS (SELECT w.id, w.own, o.other FROM w JOIN w AS o ON o.id = w.id + 1),
        f AS (SELECT *, regexp_replace(lower(own), '[^a-z0-9 ]', '', 'g') AS own_form, regexp_replace(lower(other), '[^a-z0-9 ]', '', 'g') AS other_form FROM c),
        p AS (SELECT a, b, row_number() OVER () AS p FROM (SELECT own AS a, other AS b FROM f UNION SELECT own_form, other_form FROM f)),
        {_RATIOS},
        longest AS (SELECT p, max([k, -i, -j]) AS m FROM run GROUP BY p)
        SELECT id, CAST(coalesce(-m[2] - 1, 0) AS BIGINT) AS own_start, CAST(coalesce(-m[3] - 1, 0) AS BIGINT) AS other_start, CAST(coalesce(m[1], 0) AS BIGINT) AS size, s AS sim
        FROM f JOIN s ON s.a = own_form AND s.b = other_form JOIN p ON p.a = own AND p.b = other LEFT JOIN longest ON longest.p = p.p""",
    "similar_titles": f"""
        WITH RECURSIVE w AS (SELECT p_partkey AS id, regexp_replace(lower(p_brand), '[^a-z0-9 ]', '', 'g') AS artist, regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g') AS title FROM part),
        c AS (SELECT id, 0 AS place, artist, title, artist AS cand_artist, 'the ' || title AS cand_title, 'the ' || title AS cand_core FROM w
              UNION ALL SELECT w.id, 1, w.artist, w.title, o.artist, o.title || ' radio edit', o.title FROM w JOIN w AS o ON o.id = w.id + 1),
        p AS (SELECT a, b, row_number() OVER () AS p FROM (SELECT artist AS a, cand_artist AS b FROM c UNION SELECT title, cand_title FROM c UNION SELECT title, cand_core FROM c)),
        {_RATIOS},
        g AS (SELECT id, place, o.s AS core_sim, t.s AS title_sim, r.s AS artist_sim FROM c JOIN s t ON t.a = title AND t.b = cand_title JOIN s r ON r.a = artist AND r.b = cand_artist JOIN s o ON o.a = title AND o.b = cand_core
              WHERE t.s >= {fuzzy.MIN_TITLE} AND r.s >= {fuzzy.MIN_ARTIST} AND o.s >= {fuzzy.MIN_CORE})
        SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY core_sim * 2 + title_sim + artist_sim DESC, place) = 1""",
    "candidate_search": f"""
        WITH q AS (SELECT DISTINCT upper(p_brand) AS artist, translate(p_name, 'e', 'a') || ' mix' AS title FROM part), c AS (SELECT DISTINCT p_brand AS artist, p_name AS title FROM part),
        x AS (SELECT artist AS t FROM q UNION SELECT title FROM q UNION SELECT artist FROM c UNION SELECT title FROM c),
        w AS (SELECT t, unnest(regexp_extract_all(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g'), '[^ ]+')) AS w FROM x),
        g AS (SELECT t, unnest([(' ' || w || ' ')[i : i + 1] for i in range(1, len(w) + 2)]) AS g FROM w),
        b AS (SELECT t, list(g || '#' || k) AS bag FROM (SELECT t, g, row_number() OVER (PARTITION BY t, g) AS k FROM g) GROUP BY t),
        near AS (SELECT q.t AS q, c.t AS c, len(list_intersect(q.bag, c.bag)) * 2.0::DOUBLE / (len(q.bag) + len(c.bag)) AS s FROM b q, b c),
        titles AS (SELECT q, c, s FROM near WHERE s >= {candidates.LEAST} AND q IN (SELECT title FROM q) AND c IN (SELECT title FROM c)),
        artists AS (SELECT q, c, s FROM near WHERE s >= {candidates.LEAST} AND q IN (SELECT artist FROM q) AND c IN (SELECT artist FROM c)),
        r AS (SELECT q.artist, q.title, p_partkey AS candidate, t.s * 2 + a.s AS score, row_number() OVER (PARTITION BY q.artist, q.title ORDER BY t.s * 2 + a.s DESC, p_partkey) - 1 AS place
              FROM q JOIN titles t ON t.q = q.title JOIN artists a ON a.q = q.artist JOIN part ON p_name = t.c AND p_brand = a.c QUALIFY place < 8)
        SELECT p_partkey AS query, place, candidate, CAST(floor(score * 1000000) AS BIGINT) AS millionths FROM part JOIN r ON artist = upper(p_brand) AND title = translate(p_name, 'e', 'a') || ' mix'""",
    "sound_tempo": """
        SELECT s_suppkey, CASE s_suppkey % 2 WHEN 0 THEN 'constant' ELSE 'dynamic' END AS mode, CAST(100 + s_suppkey % 5 * 10 AS INTEGER) AS low, CAST(100 + s_suppkey % 5 * 10 + s_suppkey % 2 * 20 AS INTEGER) AS high,
               ['8B', '3B', '10B', '5B', '12B', '7B', '2B', '9B', '4B', '11B', '6B', '1B'][s_suppkey % 12 + 1] AS key FROM supplier""",
    "tag_readers": "SELECT p_partkey, 'accepted' AS state, 'Rock' AS genre, p_brand AS artist, p_name AS title FROM part",
    "lookup_replies": "SELECT CAST(p_partkey AS VARCHAR) AS key, p_brand AS artist, CAST(1990 + p_size AS INTEGER) AS year, p_type || '|House' AS tags FROM part",
    "stream_failures": "SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL",
    "resolve_chain": """
        WITH l AS (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), s AS (SELECT l_orderkey, p_type FROM l JOIN part ON p = p_partkey WHERE p_size > 25)
        SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'Corrected' WHEN p_type IS NOT NULL THEN p_type WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 THEN 'Artist' WHEN o_orderstatus = 'F' THEN 'Tagged' ELSE 'Unknown' END AS genre,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'correction' WHEN p_type IS NOT NULL THEN CASE WHEN o_orderkey % 4 = 0 THEN 'remix style' ELSE 'style' END WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 THEN 'artist' WHEN o_orderstatus = 'F' THEN 'file tag' ELSE 'no match' END AS source
        FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""",
}

"""Genres from lookup replies: acceptance gates, votes, years and the specific pick, composed into one operator a service.

Replies are tables by key, so each key is asked once and its answer, also an empty one, serves all tracks that share it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions import fuzzy
from wavecrate.functions import genres as G
from wavecrate.functions import names as N
from wavecrate.operators import catalog as C
from wavecrate.operators.resolve import Stage, only
from wavecrate.sources import lookups
from wavecrate.sources.tables import kept

# How many entries of a reply count.
CANDIDATES, ARTISTS, RELEASES, DATED = 8, 1, 5, 25


def reply_key(artist: Column, track: Column) -> Column:
    """Artist and track in lower case: what a reply about a track is kept under."""
    return F.lower(F.concat(artist, F.lit(" "), track))


def _asked_for(replies: DataFrame, asked: DataFrame) -> DataFrame:
    """Replies about the keys of asked, before any is parsed."""
    return replies.join(asked.select("key"), "key", "left_semi")


def release_genres(asked: DataFrame, by_field: DataFrame, by_text: DataFrame, genre_map: DataFrame, parents: DataFrame) -> DataFrame:
    """Genre, tag and year of each key of asked (key, artist).

    Of the first RELEASES releases those by a similar artist vote with 1 / (1 + their rank among these); the genre is the
    specific pick of the votes, the year the earliest of the same releases.
    """
    rows = lookups.releases(_asked_for(by_field, asked), _asked_for(by_text, asked)).filter(F.col("place") < RELEASES).withColumnRenamed("artist", "released_by")
    rows = rows.join(asked.select("key", "artist").distinct(), "key")
    rows = rows.filter(fuzzy.similar_enough(fuzzy.MIN_ARTIST)(F.col("artist"), F.col("released_by")).isNotNull())
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("place")) - 1)
    votes = C.ranked_votes(rows, "key", "rank", "tags").withColumn("weight", F.round("weight", 9))  # sums of thirds depend on their order
    picked = C.specific_pick(votes, "key", [F.desc("weight"), F.col("first")], genre_map, parents)
    return picked.filter("genre is not null").join(C.earliest_year(rows, "key", F.col("year")), "key", "left")


def entity_genres(replies: DataFrame, genre_map: DataFrame, parents: DataFrame) -> DataFrame:
    """Genre and tag of each reply about one recording or artist: the specific pick of its names in their order."""
    tags = lookups.entity_tags(replies).withColumn("weight", F.lit(None).cast("double"))
    return C.specific_pick(tags, "key", [F.col("place")], genre_map, parents).filter("genre is not null")


def recording_genres(recordings: DataFrame, replies: DataFrame, genre_map: DataFrame, parents: DataFrame) -> DataFrame:
    """Genre and tag of each key of recordings (key, id); ids of another shape aren't looked up."""
    named = recordings.filter(N.is_record_id(F.col("id"))).select("key", "id").distinct()
    found = entity_genres(replies.join(named.select(F.col("id").alias("key")).distinct(), "key", "left_semi"), genre_map, parents)
    return named.join(found.withColumnRenamed("key", "id"), "id").select("key", "genre", "tag")


def artist_genres(artists: DataFrame, candidates: DataFrame, replies: DataFrame, genre_map: DataFrame, parents: DataFrame) -> DataFrame:
    """Genre and tag of each artist, by the first candidate (artist_key, place, id, name) if its name is similar enough."""
    first = candidates.filter((F.col("place") < ARTISTS) & N.is_record_id(F.col("id")))
    keyed = artists.select("artist").distinct().withColumn("artist_key", F.lower("artist"))
    named = keyed.join(first, "artist_key").filter(fuzzy.similar_enough(fuzzy.MIN_ARTIST)(F.col("artist"), F.col("name")).isNotNull())
    return recording_genres(named.select(F.col("artist").alias("key"), "id"), replies, genre_map, parents).withColumnRenamed("key", "artist")


def top_tag_genres(replies: DataFrame, genre_map: DataFrame, parents: DataFrame, of_tracks: bool = False) -> DataFrame:
    """Genre and tag of each reply (key): the specific pick of its top tags in their order, weighed by their counts."""
    return C.specific_pick(lookups.top_tags(replies, of_tracks), "key", [F.col("place")], genre_map, parents).filter("genre is not null")


def earliest_recording(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """A2: the earliest plausible year among the first DATED recordings whose title is similar to the track (key, track)."""
    rows = lookups.recordings(_asked_for(replies, asked)).filter(F.col("place") < DATED).join(asked.select("key", "track").distinct(), "key")
    rows = rows.filter(fuzzy.similar_enough(fuzzy.MIN_TITLE)(F.col("track"), F.coalesce("cand_title", F.lit(""))).isNotNull())
    return C.earliest_year(rows, "key", F.col("year"))


def with_era(found: DataFrame, dated: DataFrame) -> DataFrame:
    """Genres that are split by era get the older name if the lesser of both years is old."""
    both = found.join(dated.withColumnRenamed("year", "__dated"), "key", "left")
    return both.withColumn("year", F.least("year", "__dated")).withColumn("genre", G.era(F.col("genre"), F.col("year"))).drop("__dated")


@dataclass(frozen=True)
class Replies:
    """Replies (key, body) by service; None for one that isn't in use. Keys: reply_key() for releases, recordings' dates
    and tracks, an artist's name in lower case for artists, an id for recordings and artists' records."""

    release_by_field: DataFrame | None = None
    release_by_text: DataFrame | None = None
    dated: DataFrame | None = None
    recording: DataFrame | None = None
    top_track: DataFrame | None = None
    top_artist: DataFrame | None = None
    artist_search: DataFrame | None = None
    artist: DataFrame | None = None


def service_stages(item: str, replies: Replies, genre_map: DataFrame, parents: DataFrame) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """R2: the lookups of service_chain() over replies, by name. Items have artist, track, recording_id, remixer and core.

    A remix asks by its remixer and core. Items without an artist or a track (remixer or core) ask nothing.
    """

    def asked(items: DataFrame, by: str, what: str) -> DataFrame:
        named = items.select(item, F.col(by).alias("artist"), F.col(what).alias("track")).filter("artist <> '' and track <> ''")
        return named.withColumn("key", reply_key(F.col("artist"), F.col("track")))

    def release(by: str, what: str) -> Callable[[DataFrame], DataFrame]:
        def stage(items: DataFrame) -> DataFrame:
            wanted = asked(items, by, what)
            found = release_genres(wanted, replies.release_by_field, replies.release_by_text, genre_map, parents)
            if by == "artist" and replies.dated is not None:  # only what an era could change is dated again
                found = kept(found, "releases")
                split = wanted.join(found.filter(F.col("genre").isin(*G.ERA_SPLIT)).select("key"), "key", "left_semi")
                found = with_era(found, earliest_recording(split, replies.dated))
            return wanted.join(found, "key").select(item, "genre")

        return stage

    def top_artist(by: str) -> Callable[[DataFrame], DataFrame]:
        return lambda items: items.select(item, F.lower(by).alias("key")).join(top_tag_genres(replies.top_artist, genre_map, parents), "key").select(item, "genre")

    def record(by: str) -> Callable[[DataFrame], DataFrame]:
        def stage(items: DataFrame) -> DataFrame:
            found = artist_genres(items.select(F.col(by).alias("artist")), lookups.artists(replies.artist_search), replies.artist, genre_map, parents)
            return items.select(item, F.col(by).alias("artist")).join(found, "artist").select(item, "genre")

        return stage

    def track(items: DataFrame) -> DataFrame:
        wanted = asked(items, "artist", "track")
        return wanted.join(top_tag_genres(_asked_for(replies.top_track, wanted), genre_map, parents, True), "key").select(item, "genre")

    def recording(items: DataFrame) -> DataFrame:
        return recording_genres(items.select(F.col(item).alias("key"), F.col("recording_id").alias("id")), replies.recording, genre_map, parents).select(F.col("key").alias(item), "genre")

    out: dict[str, Callable[[DataFrame], DataFrame]] = {}
    if replies.release_by_field is not None:
        out |= {"remix_release": release("remixer", "core"), "release": release("artist", "track")}
    if replies.top_artist is not None:
        out |= {"top_artist": top_artist("artist"), "top_remixer": top_artist("remixer")}
    if replies.top_track is not None:
        out |= {"top_track": track}
    if replies.recording is not None:
        out |= {"recording": recording}
    if replies.artist_search is not None:
        out |= {"artist": record("artist"), "remixer": record("remixer")}
    return out


def service_chain(
    remix: Column,
    correction: Callable[[DataFrame], DataFrame],
    tag: Callable[[DataFrame], DataFrame],
    audio: Callable[[DataFrame], DataFrame],
    remix_release: Callable | None = None,
    release: Callable | None = None,
    top_artist: Callable | None = None,
    top_remixer: Callable | None = None,
    top_track: Callable | None = None,
    recording: Callable | None = None,
    artist: Callable | None = None,
    remixer: Callable | None = None,
) -> tuple[list[Stage], tuple[str, ...]]:
    """R2: the stages of the services that are in use, in the order of trust, and the names of those that must only see what is open.

    Remixes ask by their remixer alone: the release, then top tags, then the record. Originals ask the release, the
    recording and the track's top tags, then the artist's top tags and record. Without a service the file's tag leads.
    """
    asked = [
        ("remix release", remix, remix_release), ("remixer's top tags", remix, top_remixer), ("remixer's record", remix, remixer),
        ("release", ~remix, release), ("recording", ~remix, recording), ("track's top tags", ~remix, top_track),
        ("artist's top tags", ~remix, top_artist), ("artist's record", ~remix, artist),
    ]
    lookups_ = [(name, only(when, stage)) for name, when, stage in asked if stage is not None]
    stages = [("correction", correction), *lookups_, ("file tag", tag), ("audio", audio)]
    return stages, (*[name for name, _ in lookups_], "file tag", "audio")

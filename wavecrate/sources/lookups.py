"""Lookup replies: polite fetching with retries, a breaker and a rate, and the services' JSON as rows.

Without a network the replies are tables (key, body) that were fetched before; the operators join them by key.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from urllib.error import HTTPError

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavecrate.functions import names as N

# Seconds between calls to a service, and the codes after which iTunes isn't asked again.
RATES, BREAKER, ATTEMPTS = {"musicbrainz": 1.0, "discogs": 2.5, "itunes": 1.0}, (403, 409), 3
RECORDINGS = "struct<recordings: array<struct<id: string, title: string, score: int, `first-release-date`: string, `artist-credit`: array<struct<name: string, artist: struct<name: string>>>>>>"
RELEASES = "struct<results: array<struct<title: string, year: string, style: array<string>, genre: array<string>>>>"
SONGS = "struct<results: array<struct<trackName: string, artistName: string, releaseDate: string>>>"
TAGS = "struct<genres: array<struct<name: string, count: double>>, tags: array<struct<name: string, count: double>>>"
TOP_TAGS = "struct<toptags: struct<tag: array<struct<name: string, count: double>>>>"
TRACK_TAGS = f"struct<track: {TOP_TAGS}>"
ARTISTS = "struct<artists: array<struct<id: string, name: string>>>"


def http_get(url: str) -> str:
    with urllib.request.urlopen(url, timeout=30) as reply:
        return reply.read().decode()


def fetch_json(url: str, get: Callable[[str], str] = http_get, wait: Callable[[float], None] = time.sleep, attempts: int = ATTEMPTS) -> str:
    """The body, once it is JSON; after 503 and 429 a wait of 1.2 s times the attempt, after other errors 0.6 s times it."""
    for k in range(1, attempts + 1):
        try:
            body = get(url)
            json.loads(body)
            return body
        except Exception as problem:
            if k == attempts:
                raise
            wait((1.2 if isinstance(problem, HTTPError) and problem.code in (503, 429) else 0.6) * k)
    raise ValueError("no attempts")


def fetched(requests: DataFrame, service: str, get: Callable[[str], str] = http_get, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Key, body and error of each request (key, url). Keys are asked once, one after another at the service's rate."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = True
        for batch in batches:
            out = []
            for key, url in zip(batch["key"], batch["url"], strict=True):
                body, error = None, None if open_ else "not asked any more"
                if open_:
                    try:
                        body = fetch_json(url, get, wait)
                    except Exception as problem:
                        error = str(problem)
                        open_ = not (service == "itunes" and any(str(c) in error for c in BREAKER))
                    wait(RATES.get(service, 1.0))
                out.append((key, body, error))
            yield pd.DataFrame(out, columns=["key", "body", "error"])

    # One polite caller per service is what the services ask for; the requests are few and distinct.
    return requests.select("key", "url").dropDuplicates(["key"]).coalesce(1).mapInPandas(rows, "key string, body string, error string")


def recording_query(artist: Column, track: Column) -> Column:
    """S13, X15."""
    return F.concat(F.lit("artist:("), N.query_escape(artist), F.lit(") AND recording:("), N.query_escape(track), F.lit(")"))


def recordings(replies: DataFrame) -> DataFrame:
    """Key, place, id, cand_artist, cand_title and year of each recording."""
    rows = replies.select("key", F.posexplode(F.from_json("body", RECORDINGS)["recordings"]).alias("place", "r"))
    credit = F.get(F.col("r.artist-credit"), 0)
    artist = F.coalesce(F.nullif(credit["artist"]["name"], F.lit("")), credit["name"], F.lit(""))
    return rows.select("key", "place", "r.id", artist.alias("cand_artist"), F.col("r.title").alias("cand_title"), N.plausible_year(F.left(F.col("r.first-release-date"), F.lit(4))).alias("year"))


def songs(replies: DataFrame) -> DataFrame:
    """As recordings, without ids."""
    rows = replies.select("key", F.posexplode(F.from_json("body", SONGS)["results"]).alias("place", "r"))
    return rows.select("key", "place", F.lit(None).cast("string").alias("id"), F.col("r.artistName").alias("cand_artist"), F.col("r.trackName").alias("cand_title"), F.left(F.col("r.releaseDate"), F.lit(4)).try_cast("int").alias("year"))


def releases(by_field: DataFrame, by_text: DataFrame) -> DataFrame:
    """Key, place, artist, year and tags of each release; the free-text reply counts only where the fields found nothing."""
    parsed = lambda d, field: d.select("key", F.from_json("body", RELEASES)["results"].alias("r"), F.lit(field).alias("field"))
    both = parsed(by_field.filter("key is not null"), True).unionByName(parsed(by_text.filter("key is not null"), False))
    both = both.withColumn("found", F.max(F.when(F.size("r") > 0, F.col("field"))).over(Window.partitionBy("key")))
    rows = both.filter(F.col("field") == F.col("found")).select("key", F.posexplode("r").alias("place", "x"))
    tags = F.concat(F.coalesce("x.style", F.array().cast("array<string>")), F.coalesce("x.genre", F.array().cast("array<string>")))
    return rows.select("key", "place", N.release_artist(F.col("x.title")).alias("artist"), N.plausible_year(F.col("x.year")).alias("year"), tags.alias("tags"))


def entity_tags(replies: DataFrame) -> DataFrame:
    """Key, place and tag: genres, then tags, each with the most counted first."""
    from wavecrate.operators.catalog import vote_order

    parsed = F.from_json("body", TAGS)
    part = lambda name, kind: F.transform(F.coalesce(parsed[name], F.array().cast("array<struct<name: string, count: double>>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.coalesce(x["name"], F.lit("")).alias("name"), x["count"].alias("count")))
    return replies.select("key", F.posexplode(vote_order(F.concat(part("genres", 0), part("tags", 1)))).alias("place", "tag"))


def artists(replies: DataFrame) -> DataFrame:
    """artist_key, place, id and name of the artists that a search found."""
    rows = replies.select("key", F.posexplode(F.from_json("body", ARTISTS)["artists"]).alias("place", "r"))
    return rows.select(F.col("key").alias("artist_key"), "place", "r.id", F.coalesce("r.name", F.lit("")).alias("name"))


def top_tags(replies: DataFrame, of_tracks: bool = False) -> DataFrame:
    """Key, place, tag and weight; replies about tracks have their tags one level deeper."""
    parsed = F.from_json("body", TRACK_TAGS)["track"] if of_tracks else F.from_json("body", TOP_TAGS)
    rows = replies.select("key", F.posexplode(parsed["toptags"]["tag"]).alias("place", "r"))
    return rows.select("key", "place", F.col("r.name").alias("tag"), F.col("r.count").alias("weight"))

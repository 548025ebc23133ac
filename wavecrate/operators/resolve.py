"""The genre chain: stages in order of trust, with the stage that decided as provenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrate.sources import tables

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def resolve(items: DataFrame, item: str, stages: list[Stage], dear: tuple[str, ...] = ("audio",), kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Item, genre and source. A stage maps items to rows (item, genre); what none knows is Unknown.

    Stages that are joins run side by side and one aggregation takes each item's most trusted answer; staging them by
    anti joins would repeat all earlier stages in each later one. Dear stages come last and get what is left open;
    `kept` writes each one's answers and the items it leaves open, so none is run twice and nothing that is settled is
    written or joined again: by default as tables in the shared folder, where more than one stage is dear.
    """
    if kept is None and sum(name in dear for name, _ in stages) > 1:
        kept = _written
    answers = None
    for rank, (name, stage) in enumerate(stages):
        if name in dear:
            continue
        found = _answers(stage(items), item, rank, name)
        answers = found if answers is None else answers.unionByName(found)
    settled = None
    if answers is not None:
        settled = answers.groupBy(item).agg(F.min(F.struct("rank", "genre", "source")).alias("a")).select(item, "a.genre", "a.source")
    last = max((rank for rank, (name, _) in enumerate(stages) if name in dear), default=None)
    left = items
    if settled is not None and last is not None:
        settled = kept(settled) if kept else settled
        left = items.join(settled.select(item), item, "left_anti")
        left = kept(left) if kept else left
    for rank, (name, stage) in enumerate(stages):
        if name in dear:
            found = _answers(stage(left), item, rank, name).drop("rank")
            found = kept(found) if kept else found
            settled = found if settled is None else settled.unionByName(found)
            if rank != last:
                left = left.join(found.select(item), item, "left_anti")
                left = kept(left) if kept else left
    if settled is None:
        return items.select(item, F.lit("Unknown").alias("genre"), F.lit("no match").alias("source"))
    told = items.select(item).join(settled, item, "left")
    return told.select(item, F.coalesce("genre", F.lit("Unknown")).alias("genre"), F.coalesce("source", F.lit("no match")).alias("source"))


def _written(rows: DataFrame) -> DataFrame:
    return tables.kept(rows, "settled")


def _answers(found: DataFrame, item: str, rank: int, name: str) -> DataFrame:
    known = found.filter(F.col("genre").isNotNull() & (F.col("genre") != "Unknown"))
    return known.select(item, F.lit(rank).alias("rank"), "genre", F.lit(name).alias("source"))


def only(condition: Column, stage: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A stage for some items, as remixes or originals."""
    return lambda items: stage(items.filter(condition))


def chain(remix: Column, lookups: bool, correction, style, remixer_artist, recording, track, artist, tag, audio) -> list[Stage]:
    """The stages in the order of the contract: corrections; the file's tag if nothing is looked up; remixes by their
    remixer only; originals by style, recording, track and artist; the file's tag; the sound."""
    stages: list[Stage] = [("correction", correction)]
    if not lookups:
        stages.append(("file tag", tag))
    else:
        stages += [("remix style", only(remix, style)), ("remixer", only(remix, remixer_artist)), ("style", only(~remix, style)), ("recording", only(~remix, recording)), ("track", only(~remix, track)), ("artist", only(~remix, artist)), ("file tag", tag)]
    return [*stages, ("audio", audio)]

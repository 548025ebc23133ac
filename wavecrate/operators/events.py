"""Relational operators over event logs: failure windows, corrections, votes, gated means, hopping windows, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wavecrate.sources.tables import free_names, packed, unpacked

BUCKETS, CELL = 64, 1 << 16  # of a key's order; places of a cell


def failure_window(failures: DataFrame, key: str, at_s: str, window_s: int = 900, limit: int = 10) -> DataFrame:
    """For each failure the failures of its key in the window that ends with it, the oldest, and the wait in seconds (0 below the limit).

    A key's time is cut into cells of the window's length; a row also stands in the next cell, so a busy key is spread by time.
    """
    cell = F.expr(f"floor({at_s} / {window_s})")
    placed = failures.withColumn("__cell", F.explode(F.array(cell, cell + 1))).withColumn("__own", F.col("__cell") == cell)
    w = Window.partitionBy(key, "__cell").orderBy(at_s).rangeBetween(-(window_s - 1), 0)
    out = placed.withColumn("n", F.count("*").over(w)).withColumn("oldest", F.min(at_s).over(w)).filter("__own").drop("__cell", "__own")
    wait = F.greatest(F.lit(1).cast("long"), F.col("oldest") + window_s - F.col(at_s))
    return out.withColumn("retry_after", F.when(F.col("n") >= limit, wait).otherwise(0).cast("long"))


def live_failures(events: DataFrame, key: str, at_s: str, failed: Column, succeeded: Column, now: Column, window_s: int = 900) -> DataFrame:
    """T2 as a batch: failures of each key within the window before now and after the key's last success."""
    last = events.filter(succeeded).groupBy(F.col(key).alias("__key")).agg(F.max(at_s).alias("last_ok"))
    recent = events.filter(failed & (F.col(at_s) > now - window_s)).groupBy(key, at_s).agg(F.count("*").alias("n"))
    fresh = recent.join(last, F.col(key).eqNullSafe(F.col("__key")), "left").filter(F.col(at_s) > F.coalesce(F.col("last_ok"), F.lit(-1)))
    return fresh.groupBy(key).agg(F.sum("n").alias("n"), F.min(at_s).alias("oldest"))


def latest_corrections(log: DataFrame, keys: list[str], order: list[str], anonymous: Column | None = None) -> DataFrame:
    """The newest entry of each key in the place of its first; entries whose key is empty are all kept."""
    row, at = F.struct(*[F.col(c) for c in log.columns]), F.struct(*[F.col(c) for c in order])
    told = log.groupBy(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, at).alias("row"), F.min(at).getField(order[-1]).alias("place"))
    if anonymous is None:
        return told.select("row.*", "place")
    empty = F.coalesce(anonymous, F.lit(False))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__{i}"))
    others = log.filter(empty).join(told.drop("row"), same, "left").select(*log.columns, "place")
    return told.select("row.*", "place").filter(~empty).unionByName(others)


def artist_rule(log: DataFrame, artist: str, genre: str, order: str, least: int = 2) -> DataFrame:
    """A5: the genre that an artist was corrected to most often, at least `least` times; the first seen wins a tie."""
    votes = log.groupBy(artist, genre).agg(F.count("*").alias("votes"), F.min(order).alias("seen")).filter(F.col("votes") >= least)
    best = F.row_number().over(Window.partitionBy(artist).orderBy(F.desc("votes"), "seen"))
    return votes.withColumn("k", best).filter("k = 1").drop("k", "seen")


def corrected(items: DataFrame, by_track: DataFrame, by_artist: DataFrame, track_key: list[str], artist: str, genre: str) -> DataFrame:
    """The track's own correction, else its artist's rule, with the scope that decided."""
    t = by_track.select(*track_key, F.col(genre).alias("__track"))
    a = by_artist.select(artist, F.col(genre).alias("__artist"))
    out = items.join(t, track_key, "left").join(a, artist, "left")
    scope = F.when(F.col("__track").isNotNull(), "track").when(F.col("__artist").isNotNull(), "artist")
    return out.withColumn("genre", F.coalesce("__track", "__artist")).withColumn("scope", scope).drop("__track", "__artist")


def unsent(queue: DataFrame, acknowledged: DataFrame, key: str, order: list[str], limit: int | None = 200) -> DataFrame:
    """The oldest entries without acknowledgement, a batch at most; all of them without a limit."""
    left = queue.join(acknowledged.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(*order).limit(limit)


def exact_mean(value: Column, scale: int = 2) -> Column:
    """Mean of values of `scale` decimals by an exact sum, so partitioning can't change the last bit."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double") / F.count(value)


def gated_mean(rows: DataFrame, keys: list[str], value: str, floor: float, relative: float) -> DataFrame:
    """Mean of what lies over the floor and over `relative` times the mean of what lies over the floor."""
    over = rows.filter(F.col(value) > floor)
    first = over.groupBy(*keys).agg(exact_mean(F.col(value)).alias("gate"))
    kept = over.join(first, keys).filter(F.col(value) > F.col("gate") * relative)
    return kept.groupBy(*keys).agg(exact_mean(F.col(value)).alias("gated"), F.count("*").alias("n_kept"))


def sliding_windows(rows: DataFrame, key: str, at_s: str, length: int, hop: int) -> DataFrame:
    """Each row once for every whole window of its key that holds it; windows start at the key's first row."""
    span = rows.groupBy(key).agg(F.min(at_s).alias("begin"), F.max(at_s).alias("finish"))
    out = rows.join(span, key).withColumn("offset", F.col(at_s) - F.col("begin"))
    last = F.least(F.floor(F.col("offset") / hop), F.floor((F.col("finish") - F.col("begin") - length) / hop))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("offset") - length) / hop) + 1)
    inside = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("window", F.explode(inside)).drop("begin", "finish", "offset")


def positions(rows: DataFrame, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows with `pos`, the place (from 0) in the order of their key, and `n`, the rows of their key.

    Places are counted within buckets of equal width of the first order column and over the buckets, so a busy key is
    spread by time. A column that isn't a number or a time has one bucket; null places come first.
    """
    kind = rows.schema[order[0]].dataType.typeName()
    value = F.col(order[0]).cast("double") if kind not in ("string", "binary", "date", "timestamp_ntz") else F.col(order[0]).cast("timestamp").cast("double") if kind in ("date", "timestamp_ntz") else F.lit(0.0)
    low, high = rows.agg(F.min(value), F.max(value)).first()  # two numbers
    width = ((high or 0) - (low or 0)) / buckets or 1.0
    own, first, before = free_names(rows, "__bucket", "__first", "__n")
    placed = rows.withColumn(own, F.when(value.isNull(), -1).otherwise(F.least(F.floor((value - F.lit(low)) / width), F.lit(buckets - 1))).cast("int"))
    w = Window.partitionBy(key)
    counts = placed.groupBy(key, own).agg(F.count("*").alias(before))
    counts = counts.withColumn(first, F.sum(before).over(w.orderBy(own).rowsBetween(Window.unboundedPreceding, 0)) - F.col(before)).withColumn("n", F.sum(before).over(w))
    counts = counts.select(F.col(key).alias(f"{own}_key"), F.col(own).alias(f"{own}_of"), first, "n")
    ranked = placed.withColumn("pos", F.row_number().over(Window.partitionBy(key, own).orderBy(*order)) - 1)
    both = ranked.join(counts, F.col(key).eqNullSafe(F.col(f"{own}_key")) & (F.col(own) == F.col(f"{own}_of")))
    return both.withColumn("pos", F.col("pos") + F.col(first)).drop(own, first, f"{own}_key", f"{own}_of")


def in_cells(placed: DataFrame, before: int, after: int, cell: int | None = None) -> DataFrame:
    """Rows with `cell` (of CELL places) and `own`; rows up to `before` places before a cell and `after` places after it stand in it as well."""
    cell = cell or CELL
    home, within = F.expr(f"pos div {cell}"), F.col("pos") % cell
    cells = F.array(home, F.when(within >= cell - before, home + 1), F.when(within < after, home - 1))
    return placed.withColumn("cell", F.explode(F.filter(cells, lambda c: c.isNotNull()))).withColumn("own", F.col("cell") == home)


def hop_windows(rows: DataFrame, key: str, order: list[str], length: int, hop: int) -> DataFrame:
    """Rows by position in whole windows of `length` every `hop`; only keys of at least two lengths have any."""
    placed = positions(rows, key, order).filter(F.col("n") >= 2 * length)
    last = F.least(F.floor(F.col("pos") / hop), F.floor((F.col("n") - length) / hop))
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("pos") - length) / hop) + 1)
    inside = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return placed.withColumn("window", F.explode(inside))


def _by_place() -> WindowSpec:
    return Window.partitionBy("key", "cell").orderBy("pos")


def _in_order(rows: DataFrame, key: str, order: list[str], value: str, before: int, after: int) -> DataFrame:
    """Packed rows with key and value, in cells."""
    names = {f"by{i}": c for i, c in enumerate(order)}
    return in_cells(positions(packed(rows, key=key, value=value, **names), "key", list(names)), before, after)


def rising_flux(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rise from the row before, falls as 0."""
    step = F.col("value") - F.lag("value").over(_by_place())
    out = _in_order(rows, key, order, value, 1, 0).withColumn("flux", F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))))
    return unpacked(out.filter("own"), rows.columns, "flux")


def local_peaks(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows over both of their neighbours."""
    out = _in_order(rows, key, order, value, 1, 1).withColumn("before", F.lag("value").over(_by_place())).withColumn("after", F.lead("value").over(_by_place()))
    return unpacked(out.filter("own and value > before and value > after"), rows.columns)


def lookahead_min(rows: DataFrame, key: str, order: list[str], value: str, ahead: int) -> DataFrame:
    """The least value from a row to `ahead` rows after it (at most CELL)."""
    out = _in_order(rows, key, order, value, 0, ahead).withColumn("ahead_min", F.min("value").over(_by_place().rowsBetween(0, ahead)))
    return unpacked(out.filter("own"), rows.columns, "ahead_min")


def range_feed(rows: DataFrame, position: str, ranges: DataFrame, cell: int) -> DataFrame:
    """Rows with every range [start, stop) that holds their position, by an equi-join on cells of equal width."""
    cells = ranges.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {cell}"), F.expr(f"(stop - 1) div {cell}"))))
    return rows.withColumn("cell", F.expr(f"{position} div {cell}")).join(cells, "cell").filter((F.col(position) >= F.col("start")) & (F.col(position) < F.col("stop"))).drop("cell")


def tempo_mode(windows: DataFrame, key: str, value: str, reference: str, tolerance: float = 2.0) -> DataFrame:
    """Window values folded by octaves to 0.75 to 1.5 times the reference; constant within the tolerance, else dynamic."""
    # The fold is a power of two: up until 0.75 of the reference is reached, or down until 1.5 isn't exceeded.
    ratio = F.col(value) / F.col(reference)
    up = F.greatest(F.lit(0.0), F.ceil(F.log2(F.lit(0.75) / ratio)))
    down = F.greatest(F.lit(0.0), F.ceil(F.log2(ratio / F.lit(1.5))))
    folded = windows.withColumn("folded", F.col(value) * F.pow(F.lit(2.0), up - down))
    out = folded.groupBy(key, reference).agg(F.count("*").alias("n"), F.min("folded").alias("low"), F.max("folded").alias("high"), F.median("folded").alias("mid"))
    steady = (F.col("n") < 2) | (F.col("high") - F.col("low") <= tolerance)
    return out.withColumn("mode", F.when(steady, "constant").otherwise("dynamic")).withColumn("value", F.when(steady, F.col(reference)).otherwise(F.col("mid")))

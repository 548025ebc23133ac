"""W11 as a stream: results that finish in any order leave in the order of their places, key by key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PLACES = 256  # of a key that are kept in one value


class ReleaseProcessor(StatefulProcessor):
    """Keeps the next place that is due and what came early; releases runs without gaps.

    A place that comes again is left out. What can leave at once never enters the state. What came early is kept by
    runs of PLACES places, so a batch reads and writes a key's state once a run and not once a row.
    """

    def __init__(self, key: str, place: str, columns: list[str], early: str) -> None:
        self.names, self.early_schema = (key, place, *columns), early

    def init(self, handle) -> None:
        self.due = handle.getValueState("due", "place bigint, held bigint")
        self.early = handle.getMapState("early", "run bigint", self.early_schema)

    def _kept(self, run: int) -> dict[int, tuple]:
        found = self.early.getValue((run,))
        return {} if found is None else {row[0]: row[1:] for row in zip(*found, strict=True)}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, held = self.due.get() or (0, 0)
        new, runs, stored, made = {}, {}, held > 0, Row(*self.names)
        for row in rows:
            if row[1] >= due:
                new.setdefault(row[1], row[2:])

        def kept(place: int) -> dict[int, tuple]:
            """What came early of the place's run."""
            run = place // PLACES
            if run not in runs:
                found = self._kept(run) if stored else {}
                runs[run] = [found, len(found), False]
            return runs[run][0]

        while due in new or held:
            early = kept(due) if held else {}
            if due in early:  # it may have come again by now: the first one counts
                row = early.pop(due)
                held -= 1
                runs[due // PLACES][2] = True
                new.pop(due, None)
            elif due in new:
                row = new.pop(due)
            else:
                break
            yield made(key[0], due, *row)
            due += 1
        for place, row in new.items():
            early = kept(place)
            if place not in early:
                early[place] = tuple(row)
                held += 1
                runs[place // PLACES][2] = True
        for run, (early, before, changed) in runs.items():
            if changed and early:
                self.early.updateValue((run,), tuple(map(list, zip(*[(place, *early[place]) for place in sorted(early)], strict=True))))
            elif changed and before:
                self.early.removeKey((run,))
        self.due.update((due, held))


def in_order(results: DataFrame, key: str, place: str, columns: list[str]) -> DataFrame:
    """key, place (from 0) and columns of what is released, each key's in order; start it within keyed_state(), in append mode."""
    kinds = {f.name: f.dataType.simpleString() for f in results.schema}
    early = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    lists = ", ".join(["`place` array<bigint>", *[f"`c{i}` array<{kinds[c]}>" for i, c in enumerate(columns)]])
    rows = results.select(key, F.col(place).cast("long").alias(place), *columns).filter(F.col(key).isNotNull() & (F.col(place) >= 0))
    return rows.groupBy(key).transformWithState(ReleaseProcessor(key, place, columns, lists), f"`{key}` {kinds[key]}, `{place}` bigint, {early}", "append", "none")

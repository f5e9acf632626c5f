"""Turns with details and counters, followed as a stream.

A turn's counter stands in for details that are not there: once a detail of the
turn comes, in whatever batch, its counters are retracted, and where the first of
them differs from the sum of the details, a conflict says so. Changes are signed:
what is added counts 1, what is retracted -1, and their sum is what
``usage.settle_turns`` makes of all records at once, however they are dealt to batches.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from costgrain.functions.identity import with_identity
from costgrain.functions.vocabulary import is_measured, source_rank
from costgrain.operators.usage import COMPARED
from costgrain.sources.observation import COLUMNS

_ROW = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())
_AT = {c: k for k, c in enumerate(COLUMNS)}
#: Records that a turn's one value holds at most.
FEW = 64
CHANGE = f"what string, sign int, {_ROW}, details string"
_Change = Row("what", "sign", *COLUMNS, "details")


def better(new: tuple, old: tuple) -> bool:
    """Does ``new`` take the place of ``old``? (rank, measured, path, offset): of equals the first in order stays."""
    return new[:2] > old[:2] or (new[:2] == old[:2] and new[2:] < old[2:])


class Covered(StatefulProcessor):
    """State of one turn: the best detail and the best counter of each identity, how many details and
    their sum, the first counter, and the conflict that was told. It goes when nothing has come for ``ttl`` seconds.

    Each call of the state costs a message to the executor, so a turn is one value that is read and written once
    a batch. The records of a turn with over ``few`` of them go to map states, each under its identity, so that a batch
    reads and writes only those it has.
    """

    def __init__(self, ttl: int, few: int):
        self.ttl, self.few = ttl, few

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = f"rank int, measured boolean, path string, place long, {_ROW}"
        ms = 1_000 * self.ttl
        sums = ", ".join(f"d_{t} long" for t in COMPARED)
        self.turn = handle.getValueState("turn", f"n long, {sums}, first struct<{_ROW}>, told string, many boolean, kept array<struct<counter boolean, hash string, {kept}>>", ms)
        self.details = handle.getMapState("details", "hash string", kept, ms)
        self.counters = handle.getMapState("counters", "hash string", kept, ms)
        self.cells = self.standing = None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, *sums, first, told, many, near = self.turn.get() or (0, *[0] * len(COMPARED), None, None, False, [])
        first = was_first = tuple(first) if first is not None else None
        best: dict[tuple[bool, str], tuple] = {(v[0], v[1]): tuple(v)[2:] for v in near}
        new: set[tuple[bool, str]] = set()
        change: Counter = Counter()
        for r in rows:
            if self.cells is None:
                names = r.__fields__
                self.cells, self.standing = (itemgetter(*map(names.index, x)) for x in (COLUMNS, ("_rank", "_measured", "source_path", "source_offset", "_counter", "_hash")))
            row = tuple(r)
            cells = self.cells(row)
            rank, measured, path, place, counter, name = self.standing(row)
            stand = (rank, measured, path or "", place or 0)
            if counter and (first is None or stand[2:] < self._place(first)):
                first = cells
            old = best.get((counter, name))
            if old is None and many:
                state = self.counters if counter else self.details
                old = tuple(state.getValue((name,))) if state.containsKey((name,)) else None
            if old is not None and not better(stand, old[:4]):
                continue
            best[counter, name] = (*stand, *cells)
            new.add((counter, name))
            if counter and n:
                continue  # details cover it
            if not counter:
                if n == 0:  # the first detail: what counters stood for goes
                    stood = {k[0]: tuple(v) for k, v in self.counters.iterator()} if many else {}
                    stood |= {k: v for (is_counter, k), v in best.items() if is_counter}
                    change.subtract(("kept", *v[4:], None) for v in stood.values())
                n += old is None
                sums = [s + (cells[_AT[t]] or 0) - ((old[4 + _AT[t]] or 0) if old else 0) for s, t in zip(sums, COMPARED, strict=True)]
            if old is not None:
                change[("kept", *old[4:], None)] -= 1
            change[("kept", *cells, None)] += 1
        conflict = None
        if n and first is not None and sums != [first[_AT[t]] or 0 for t in COMPARED]:
            conflict = json.dumps({f"d_{t}": s for t, s in zip(COMPARED, sums, strict=True)}, separators=(",", ":"))
        if told is not None:
            change[("conflict", *was_first, told)] -= 1
        if conflict is not None:
            change[("conflict", *first, conflict)] += 1
        if many or len(best) > self.few:
            for counter, name in new if many else best:
                (self.counters if counter else self.details).updateValue((name,), best[counter, name])
            many, best = True, {}
        self.turn.update((n, *sums, first, conflict, many, [(*k, *v) for k, v in best.items()]))
        for row, sign in change.items():
            if sign:
                yield _Change(row[0], sign, *row[1:])

    @staticmethod
    def _place(cells: tuple) -> tuple:
        return cells[_AT["source_path"]] or "", cells[_AT["source_offset"]] or 0

    def close(self) -> None:
        pass


def follow_turns(observations: DataFrame, is_counter: Column, ttl: int = 30 * 86_400, few: int = FEW) -> DataFrame:
    """Signed changes (``CHANGE``) of what counts, from a stream of observations.

    ``what`` is ``kept`` for records and ``conflict`` for a turn whose first counter (the row) differs from the
    sum of its details. Records without a turn are kept as they are. The session needs
    ``hooks.stateful_session``'s state store; all records of one turn meet in one task.
    """
    standing = with_identity(observations.select(*COLUMNS)).withColumns({"_rank": F.coalesce(source_rank(F.col("source")), F.lit(-1)), "_measured": is_measured(), "_counter": F.coalesce(is_counter, F.lit(False)), "_hash": F.col("event_hash")})
    loose = standing.where("turn_id is null").select(F.lit("kept").alias("what"), F.lit(1).alias("sign"), *COLUMNS, F.lit(None).cast("string").alias("details"))
    turned = standing.where("turn_id is not null").select(*COLUMNS, "_rank", "_measured", "_counter", "_hash")
    followed = turned.groupBy("session", "turn_id").transformWithState(Covered(ttl, few), CHANGE, "append", "ProcessingTime")
    return loose.unionByName(followed)


def net(changes: DataFrame) -> DataFrame:
    """What changes add up to: (what, columns of observations, details), a record as often as it stands."""
    left = changes.groupBy("what", *COLUMNS, "details").agg(F.sum("sign").alias("_n")).where("_n > 0")
    return left.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_i", "_n")

"""Event streams followed as they grow: context and counters carried from batch to batch.

A file's records are taken in the order of their offsets. Session, turn and agents that a
record doesn't tell are those of earlier ones, and cumulative readings count what they exceed
their stream's by, just as ``transcripts.streams_of`` does over whole files. A batch that begins before the
last one ended is that of a file that began anew: its state does so too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from costgrain.functions.vocabulary import TOKENS
from costgrain.operators.deltas import RESET
from costgrain.sources import transcripts
from costgrain.sources.observation import COLUMNS

OUT = ", ".join(f"{c} {t}" for c, t in COLUMNS.items()) + ", reset boolean"
_Out = Row(*COLUMNS, "reset")


def counted(values: list, base: list | None, cumulative: bool) -> tuple[list, list, bool]:
    """(what a reading adds, the stream's new base, whether it began anew) after the base, if there is one.

    Plain readings count as they are and raise the base; a cumulative one counts what it exceeds it by, whole where it is
    the first or falls below; a counter that falls without beginning a stream anew is unknown."""
    known = [v or 0 for v in values]
    if not cumulative:
        return values, [b + v for b, v in zip(base, known, strict=True)] if base else known, False
    if base is None:
        return values, known, False
    if any(v < b for t, v, b in zip(TOKENS, known, base, strict=True) if t in RESET):
        return values, known, True
    return [v - b if v >= b else None for v, b in zip(known, base, strict=True)], known, False


#: Bases of a file's latest streams that lie in one value with its context: each look into the state costs a message.
NEAR = 64


class Context(StatefulProcessor):
    """State of a file: the context so far, where it ends, and the base of each of its streams, those of all but the latest
    ``near`` in an entry each. It goes when nothing has come for ``ttl`` seconds; then the file's next record has no context."""

    def __init__(self, ttl: int, parser_version: str, near: int = NEAR):
        self.ttl, self.version, self.near = ttl, parser_version, near

    def init(self, handle: StatefulProcessorHandle) -> None:
        ms = 1_000 * self.ttl
        stream = "session string, turn string, model string, agent string"
        base = ", ".join(f"{t} long" for t in TOKENS)
        self.now = handle.getValueState("now", f"session string, turn string, agent string, parent string, place long, near array<struct<{stream}, {base}>>, far boolean", ms)
        self.bases = handle.getMapState("bases", stream, base, ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: r["source_offset"])
        was = self.now.get()
        session, turn, agent, parent, place, near, far = was or (None, None, None, None, -1, [], False)
        if rows[0]["source_offset"] <= place:
            if far:
                self.bases.clear()
            session = turn = agent = parent = None
            near, far = [], False
        bases = {tuple(b[:4]): list(b[4:]) for b in near}
        for r in rows:
            if r["_close"]:
                session = agent = parent = None
            if r["_end"]:
                turn = None
            session, turn, agent, parent = r["_session"] or session, r["_turn"] or turn, r["_agent"] or agent, r["_parent"] or parent
            values = [r[t] for t in TOKENS]
            if all(v is None for v in values):
                continue
            told = r.asDict()
            told |= {"session": session or r["session"], "turn_id": r["turn_id"] or turn, "agent_id": r["agent_id"] or agent, "parent_agent_id": r["parent_agent_id"] or parent, "parser_version": self.version}
            stream = (told["session"], told["turn_id"] or "", told["model"] or "", told["agent_id"] or "root")
            base = bases.pop(stream, None)
            if base is None and far and self.bases.containsKey(stream):
                base = list(self.bases.getValue(stream))
            out, bases[stream], reset = counted(values, base, r["parser_version"] == "cumulative")
            told |= dict(zip(TOKENS, out, strict=True))
            yield _Out(*(told[c] for c in COLUMNS), reset)
        for stream in list(bases)[: max(0, len(bases) - self.near)]:
            self.bases.updateValue(stream, tuple(bases.pop(stream)))
            far = True
        self.now.update((session, turn, agent, parent, rows[-1]["source_offset"], [(*s, *b) for s, b in bases.items()], far))

    def close(self) -> None:
        pass


def follow_streams(lines: DataFrame, adapter: str = "codex", parser_version: str = "1", ttl: int = 30 * 86_400, near: int = NEAR) -> DataFrame:
    """Observations (and whether a stream ``reset``) of a stream of lines of event streams (``tail.follow``), before turns are
    settled (``turns.follow_turns``). The records of a batch of one file meet in one task, in order."""
    good, _ = transcripts.stream_records(lines)
    readings = transcripts.stream_readings(good, adapter, own=True)
    return readings.groupBy("source_path").transformWithState(Context(ttl, parser_version, near), OUT, "append", "ProcessingTime")

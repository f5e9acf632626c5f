"""The hook spool: events that tools append line by line, followed as a stream.

Prompts open turns, a stop ends the latest open one, a session's end ends the
session, in the order of their time however late they come. What is no sound event goes to quarantine as a fingerprint, never as
text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The fields of a payload that may be kept.
KEPT = ["session_id", "prompt_id", "transcript_path", "cwd", "permission_mode", "agent_id", "parent_agent_id", "task_id", "tool_name", "tool_use_id", "source"]
# Tools that write files.
WRITERS = ["Write", "Edit", "MultiEdit"]
ENVELOPE = "struct<version: bigint, kind: string, capturedAt: string, payload: struct<" + ", ".join(f"{c}: string" for c in [*KEPT, "prompt_fingerprint", "file_path"]) + ">>"


def sanitise(payload: Column, prompt: Column, event: Column | None = None, path: Column | None = None) -> Column:
    """The kept fields of a payload, and the prompt only as its SHA-256; the path of a tool's
    input (``path``) where ``event`` tells that the tool has written to it."""
    kept = [payload[c].alias(c) for c in KEPT]
    if event is not None:
        wrote = (event == "PostToolUse") & payload["tool_name"].isin(*WRITERS)
        kept.append(F.when(wrote, path).alias("file_path"))
    return F.struct(*kept, F.sha2(prompt, 256).alias("prompt_fingerprint"))


def follow_spool(spark: SparkSession, folder: str) -> DataFrame:
    """The spool's lines as a stream (column ``line``); rotated files are picked up as they come."""
    return spark.readStream.format("text").option("pathGlobFilter", "*.jsonl*").load(folder).select(F.col("value").alias("line"))


def stateful_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB, as typed state needs it;
    ``partitions`` is the number of state partitions, which a stream keeps for good."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Else a stream with timers runs batches without data for ever; timers go off with the next data.
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(partitions or spark.conf.get("spark.sql.shuffle.partitions")))
    return own


def envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound events, quarantine) of lines, streaming or not; an event without a session is malformed."""
    e = F.from_json("line", ENVELOPE)
    parsed = lines.where(F.trim("line") != "").withColumn("e", e)
    place = ["source_offset"] if "source_offset" in lines.columns else []
    sound = F.coalesce(F.col("e.kind").isNotNull() & F.col("e.capturedAt").isNotNull() & (F.col("e.version") == 1), F.lit(False))
    session = F.trim("e.payload.session_id")
    named = F.coalesce(session != "", F.lit(False))
    good = parsed.where(sound & named).select(F.col("e.kind").alias("kind"), F.col("e.capturedAt").alias("captured_at"), session.alias("session_id"), F.col("e.payload").alias("payload"), *place)
    bad = parsed.where(~(sound & named)).select(F.sha2("line", 256).alias("fingerprint"), F.octet_length("line").alias("bytes"), F.when(F.col("e").isNull() | F.col("e.kind").isNull() | (sound & ~named), "malformed").otherwise("unsupported").alias("label"))
    return good, bad


class Turn(NamedTuple):
    """A turn of a session: opened by a prompt, ended by a stop."""

    name: str
    sequence: int
    started_at: str
    ended_at: str | None
    prompt_fingerprint: str | None


class Event(NamedTuple):
    """A hook event; events of a session are taken in the order of these fields."""

    at: int
    captured_at: str
    place: int
    kind: str
    prompt_id: str | None
    prompt_fingerprint: str | None


def fold(open_turns: list[Turn], count: int, known: Callable[[str], bool], events: list[Event]) -> tuple[dict[str, Turn], list[str], int, list[str]]:
    """What events make of a session: (turns by name, names of the open ones, number of turns, names that are new).

    A prompt opens a turn that its id names, else its number; one whose name is known opens nothing.
    A stop ends the latest open turn, if there is one.
    """
    turns, stack, new = {t.name: t for t in open_turns}, [t.name for t in open_turns], []
    for e in events:
        if e.kind == "UserPromptSubmit":
            name = e.prompt_id or str(count)
            if name in turns or name in new or known(name):
                continue
            turns[name] = Turn(name, count, e.captured_at, None, e.prompt_fingerprint)
            stack.append(name)
            new.append(name)
            count += 1
        elif e.kind in ("Stop", "StopFailure") and stack:
            name = stack.pop()
            turns[name] = turns[name]._replace(ended_at=e.captured_at)
    return turns, stack, count, new


_TURN = "name string, sequence long, started_at string, ended_at string, prompt_fingerprint string"
_EVENT = "at long, captured_at string, place long, kind string, prompt_id string, prompt_fingerprint string"


class Sessions(StatefulProcessor):
    """Turns of each session in the order of their time, however events are dealt to batches.

    Events of the last ``horizon`` seconds stay in state as they came. A batch puts its own among them
    and tells how the turns that follow differ from what they were; what is older is settled for good, and an
    event that comes later still counts as if it came right after that. A session's state goes
    when nothing has come for ``idle`` seconds, or for ``after_end`` seconds since it ended.
    """

    def __init__(self, horizon: int, idle: int, after_end: int):
        self.horizon, self.idle, self.after_end = horizon, idle, after_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _EVENT)
        self.open = handle.getListState("open", _TURN)
        self.names = handle.getMapState("names", "name string", "sequence long")
        self.rest = handle.getValueState("rest", "turns long, revision long, started_at long, started string, ended_at long, ended string")

    def _known(self, name: str) -> bool:
        return self.names.containsKey((name,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = [Event(*(r[f] for f in Event._fields)) for r in rows]
        rest = self.rest.get()
        count, revision, start, started, end, ended = rest or (0, 0, None, None, None, None)
        # Each look into the state costs a message: a new session has none, and one of which nothing is settled neither turns nor names.
        held = [Event(*e) for e in self.pending.get()] if rest else []
        open_ = [Turn(*t) for t in self.open.get()] if count else []
        first, ends = min(came), [e for e in came if e.kind == "SessionEnd"]
        before = (started, ended)
        if start is None or first.at < start:
            start, started = first.at, first.captured_at
        if ends and (end is None or max(ends).at >= end):
            end, ended = max(ends).at, max(ends).captured_at
        known = functools.cache(self._known) if count else lambda name: False
        order = lambda e: (*e[:4], e[4] or "", e[5] or "")
        was = fold(open_, count, known, sorted(held, key=order))[0]
        now = sorted(held + came, key=order)
        turns = fold(open_, count, known, now)[0]
        out = [("turn", key[0], t.name, t.sequence, t.started_at, t.ended_at, t.prompt_fingerprint, False) for n, t in turns.items() if was.get(n) != t and not (n not in was and t in open_)]
        out += [("turn", key[0], t.name, t.sequence, t.started_at, t.ended_at, t.prompt_fingerprint, True) for n, t in was.items() if n not in turns]
        if before != (started, ended):
            out.append(("session", key[0], None, None, started, ended, None, False))
        # What is older than the horizon is settled.
        line = max(e.at for e in now) - self.horizon * 1_000_000
        old = [e for e in now if e.at < line]
        if old:
            settled, stack, count, new = fold(open_, count, known, old)
            if stack:
                self.open.put([tuple(settled[n]) for n in stack])
            elif open_:
                self.open.clear()
            for n in new:
                self.names.updateValue((n,), (settled[n].sequence,))
        fresh = now[len(old) :]
        if not old:
            self.pending.appendList([tuple(e) for e in came])
        elif fresh:
            self.pending.put([tuple(e) for e in fresh])
        else:
            self.pending.clear()
        self.rest.update((count, revision + 1, start, started, end, ended))
        for t in list(self.handle.listTimers()) if rest else []:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * (self.idle if end is None else self.after_end))
        for o in out:
            yield _Change(*o, revision)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for state in (self.pending, self.open, self.names, self.rest):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


_Change = Row("what", "session_id", "turn", "sequence", "started_at", "ended_at", "prompt_fingerprint", "gone", "revision")
CHANGE = "what string, session_id string, turn string, sequence long, started_at string, ended_at string, prompt_fingerprint string, gone boolean, revision long"


def turns(events: DataFrame, horizon: int = 3_600, idle: int = 7 * 86_400, after_end: int = 3_600) -> DataFrame:
    """A stream of changes of turns and sessions, from a stream of events (see ``envelopes``).

    ``what`` tells which of the two; the last ``revision`` of a turn or session holds, and one that is
    ``gone`` is none: a turn named by its number may get another number when an earlier prompt comes late.
    Events whose time can't be read stand at their session's beginning. The session needs
    ``stateful_session``'s state store.
    """
    place = F.col("source_offset") if "source_offset" in events.columns else F.lit(0)
    at = F.coalesce(F.unix_micros(F.try_to_timestamp("captured_at")), F.lit(0))
    flat = events.select("session_id", at.alias("at"), "captured_at", place.cast("long").alias("place"), "kind", F.col("payload.prompt_id").alias("prompt_id"), F.col("payload.prompt_fingerprint").alias("prompt_fingerprint"))
    return flat.groupBy("session_id").transformWithState(Sessions(horizon, idle, after_end), CHANGE, "append", "ProcessingTime")


def current_turns(changes: DataFrame) -> DataFrame:
    """Each turn as its last revision has it."""
    last = F.max_by(F.struct("sequence", "started_at", "ended_at", "prompt_fingerprint", "gone"), "revision").alias("r")
    return changes.where("what = 'turn'").groupBy("session_id", "turn").agg(last).where("not r.gone").select("session_id", "turn", "r.sequence", "r.started_at", "r.ended_at", "r.prompt_fingerprint")


def current_sessions(changes: DataFrame) -> DataFrame:
    """Each session with its first event's time and, where it has ended, its last end's."""
    last = F.max_by(F.struct("started_at", "ended_at"), "revision").alias("r")
    return changes.where("what = 'session'").groupBy("session_id").agg(last).select("session_id", "r.*")

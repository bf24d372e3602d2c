"""Keyed state of streams: facts put in order by key, folded one at a time, and event-time timers.

Facts may reach the stream in any order within the watermark's delay.  A key's state holds what its
facts have led to and the facts that still wait: one is folded when the watermark has passed its time, in the order of
``seq`` (which has to rise with time within a key), so that however the facts fall into micro-batches
the end is the same.  A batch touches the state of its own keys, and of those whose timers it sets off, and no other.

Each time a key is touched one row says where it stands, waiting facts counted in, so a reader sees what
is known now; ``step`` numbers a key's rows.
"""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators import lifecycle

KEPT = StructType([StructField("kept", BinaryType())])
State = dict[str, Any]
Step = Callable[[State, Row], State]


def _local(x: Any) -> Any:
    """State gives times back without a zone, as this machine's; rows come with one."""
    return x.astimezone().replace(tzinfo=None) if isinstance(x, datetime.datetime) and x.tzinfo else x


def _us(at: datetime.datetime) -> int:
    return round(at.timestamp() * 1e6)


def _timer(at: datetime.datetime) -> int:
    """The first millisecond that is not before a moment."""
    return -(-_us(at) // 1000)


def _after(at: datetime.datetime, seconds: float) -> datetime.datetime:
    return at + datetime.timedelta(seconds=seconds)


def message_step(s: State, f: Row) -> State:
    """One fact of a message's lifecycle: the rules of ``lifecycle.MESSAGE`` as a function."""
    state, kind, out = s["state"], f["kind"], dict(s)
    settled = False
    if state == "" and kind != "captured":
        return out
    if state == "":
        out["state"] = "AnalyzePending"
    elif state == "AnalyzePending" and kind == "analyzed":
        out["state"], settled = ("ProjectPending", False) if f["ok"] else ("Excluded", True)
    elif state in ("AnalyzePending", "ProjectPending") and kind in ("fault", "timeout"):
        out["state"], settled = "Faulted", True
    elif state in ("Tagging", "Classifying") and kind == "fault":
        out["state"], settled = "Faulted", True
    elif (state, kind) in (("ProjectPending", "projected"), ("Tagging", "tagged"), ("Classifying", "classified")):
        if s["pending"]:  # an edit came meanwhile: what was made is discarded and the message projected anew
            out |= {"state": "ProjectPending", "pending": False, "n_coalesced": s["n_coalesced"] + 1}
            out |= {} if state == "ProjectPending" else {"embedded": False}
            out |= {"tagged": False} if state == "Classifying" else {}
        elif state == "ProjectPending":
            out |= {"state": "Tagging", "embedded": False, "tagged": False}
        elif state == "Tagging":
            out |= {"state": "Classifying", "embedded": True}
        else:
            out |= {"state": "Enriched", "tagged": True, "n_enriched": s["n_enriched"] + 1}
            settled = True
    elif kind == "edit" and state == "Enriched":
        out["state"] = "ProjectPending"
    elif kind == "edit" and state in ("AnalyzePending", "ProjectPending", "Tagging", "Classifying"):
        out["pending"] = True
    elif state == "Enriched" and kind in ("tags_invalidated", "classify_invalidated"):
        out["state"] = "Tagging" if kind == "tags_invalidated" else "Classifying"
    elif state == "Faulted" and kind == "replay" and not (s["embedded"] and s["tagged"]):
        out["state"] = "Classifying" if s["embedded"] else "Tagging"
    return _stamped(s, out, f, kind in MESSAGE_KINDS, settled)


MESSAGE_KINDS = "captured analyzed projected tagged classified edit fault timeout replay tags_invalidated classify_invalidated".split()


def _stamped(s: State, out: State, f: Row, handled: bool, settled: bool) -> State:
    if handled:
        out["created_on"] = s["created_on"] or f["at"]
        out["updated_on"] = f["at"] or s["updated_on"]
    if settled:
        out["settled_on"] = f["at"] or s["settled_on"]
    return out


def channel_step(s: State, f: Row) -> State:
    """The rules of ``lifecycle.CHANNEL`` as a function."""
    state, kind, out = s["state"], f["kind"], dict(s)
    done = state == "Syncing" and kind == "completed"
    if kind == "sync_due" and state in ("", "CaughtUp"):
        out["state"] = "Syncing"
        out["caught_up"] = s["caught_up"] and state != "CaughtUp"
    elif done:
        out |= {"state": "CaughtUp", "cursor": max(s["cursor"], s["cursor"] if f["number"] is None else f["number"]), "caught_up": bool(f["ok"])}
        out |= {"last_count": s["last_count"] if f["size"] is None else f["size"], "profile": Row(name=f["name"], type=f["type"], parent_id=f["parent"])}
        out["last_synced"] = f["at"] or s["last_synced"]
    elif kind == "changed" and state and f["ok"] is False:
        out["is_present"] = False
    elif kind == "pins" and state == "CaughtUp":
        out["pins"] = s["pins"] if f["digest"] is None else f["digest"]
    return _stamped(s, out, f, kind == "sync_due" or (state != "" and kind in ("completed", "changed", "pins", "poll")), done)


def guild_step(s: State, f: Row) -> State:
    """The rules of ``lifecycle.GUILD`` as a function; whether a sync is stale is told from the state itself."""
    state, kind, out = s["state"], f["kind"], dict(s)
    last = s["last_synced"]
    beat = kind == "heartbeat" and state == "Synced" and s["is_present"] and (last is None or (f["cutoff"] is not None and last < f["cutoff"]))
    changed = kind == "changed" and state != ""
    if beat or (kind == "sync_due" and state in ("", "Synced")):
        out["state"] = "Syncing"
    if changed:
        out |= {"state": "Synced", "is_present": s["is_present"] and f["ok"] is not False, "last_synced": f["synced_at"] or f["at"] or last}
        out["profile"] = Row(name=f["name"], roles=f["roles"])
    return _stamped(s, out, f, kind == "sync_due" or changed or beat, changed and state == "Syncing")


def message_asks(before: State, f: Row, after: State) -> bool:
    """Whether a fact sends a request that has to be answered in time."""
    return after["state"] in ("AnalyzePending", "ProjectPending") and (before["state"] != after["state"] or f["kind"] == "projected")


#: Each lifecycle's rules for tables, and for one fact.
STEPS: list[tuple[lifecycle.Transitions, Step]] = [(lifecycle.MESSAGE, message_step), (lifecycle.CHANNEL, channel_step), (lifecycle.GUILD, guild_step)]


class Request(NamedTuple):
    """Requests of a lifecycle: when one is sent, in which states it is open, and the seconds that it may take."""

    asks: Callable[[State, Row, State], bool]
    states: tuple[str, ...]
    seconds: float


class _Ordered(StatefulProcessor):
    """Facts by key in the order of ``seq``, each when the watermark has passed its time."""

    def __init__(self, state: StructType, fact: StructType, out: StructType):
        self.state_schema, self.fact_schema = state, fact
        self.names, self.out = fact.names, out.names
        self.seq = fact.names.index("seq")

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("state", self.state_schema)
        # the facts that wait and the timers that are set, as one value: a turn reads and writes it once, however many they are
        self.kept = handle.getValueState("kept", KEPT)

    def _facts(self, rows: Iterator[Row]) -> list[Row]:
        kept = self.kept.get()
        held, self.timers = pickle.loads(bytes(kept[0])) if kept is not None else ([], [])
        fact, at = Row(*self.names), self.seq
        facts = [fact(*f) for f in (*held, *(tuple(_local(r[n]) for n in self.names) for r in rows))]
        if None not in (seqs := {f[at] for f in facts}) and len(seqs) == len(facts):
            return sorted(facts, key=lambda f: f[at])
        return sorted(facts, key=lambda f: [(x is not None, x if not isinstance(x, (list, Row)) else str(x)) for x in (f[at], *f)])

    def _released(self, facts: list[Row], now: int) -> tuple[list[Row], list[Row]]:
        n = next((k for k, f in enumerate(facts) if f["at"] is not None and _us(f["at"]) > 1000 * now), len(facts))
        return facts[:n], facts[n:]

    def _keep(self, value: tuple, waiting: list[Row], due: datetime.datetime | None) -> None:
        """Writes the state, and a timer for the first fact that waits and for what is due."""
        timers = [_timer(at) for at in (*(f["at"] for f in waiting[:1]), due) if at is not None]
        self.held.update(value)
        self.kept.update((pickle.dumps(([tuple(f) for f in waiting], timers)),))
        known = set(self.timers)
        for old in known - set(timers):
            self.handle.deleteTimer(old)
        for new in set(timers) - known:
            self.handle.registerTimer(new)

    def _row(self, *values: Any) -> Row:
        return Row(*self.out)(*values)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        yield from self.turn(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self.turn(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class Lifecycle(_Ordered):
    """Folds a key's facts by ``step``; a request without an answer in time becomes a fact of kind ``timeout``.

    The state's schema begins with ``step``, ``deadline`` and ``n_facts``.  The deadline is event time: facts up to it are
    folded first, and it is met as soon as a later fact is folded or the watermark has passed it.
    """

    def __init__(self, state: StructType, fact: StructType, out: StructType, step: Step, start: State, request: Request | None):
        super().__init__(state, fact, out)
        self.step, self.start, self.request = step, start, request

    def _expire(self, s: State, deadline: datetime.datetime) -> State:
        return self.step(s, Row(**(dict.fromkeys(self.names) | {"kind": "timeout", "at": deadline})))

    def _fold(self, s: State, deadline: datetime.datetime | None, n: int, facts: list[Row]) -> tuple[State, datetime.datetime | None, int]:
        for f in facts:
            if deadline is not None and f["at"] is not None and deadline < f["at"]:
                s, deadline = self._expire(s, deadline), None
            before, s = s, self.step(s, f)
            n += 1
            if self.request is None:
                continue
            if self.request.asks(before, f, s) and f["at"] is not None:
                deadline = _after(f["at"], self.request.seconds)
            elif s["state"] not in self.request.states:
                deadline = None
        return s, deadline, n

    def turn(self, key, rows: Iterator[Row], now: int) -> Iterator[Row]:
        step, deadline, n, s = 0, None, 0, dict(self.start)
        if (held := self.held.get()) is not None:
            step, deadline, n, *values = map(_local, held)
            s = dict(zip(self.start, values, strict=True))
        folded, waiting = self._released(self._facts(rows), now)
        s, deadline, n = self._fold(s, deadline, n, folded)
        if deadline is not None and _us(deadline) <= 1000 * now:
            s, deadline = self._expire(s, deadline), None
        self._keep((step + 1, deadline, n, *s.values()), waiting, deadline)
        shown, _, n = self._fold(s, deadline, n, waiting)
        yield self._row(*key, step + 1, n, *shown.values())


class Timers(_Ordered):
    """Timers that facts of some kinds set, for ``seconds`` after them; a key has one at a time, and another fact ends it.

    A fact of a kind in ``sets`` replaces the key's timer; any other cancels it, if ``cancels``.  A fact after the due
    moment comes too late for either.  Rows: the timer's ``seq``, ``due`` and ``status`` (open, fired, cancelled); the
    last of a ``seq`` counts.
    """

    def __init__(self, state: StructType, fact: StructType, out: StructType, sets: tuple[str, ...], seconds: float, cancels: bool):
        super().__init__(state, fact, out)
        self.sets, self.seconds, self.cancels = sets, seconds, cancels

    def turn(self, key, rows: Iterator[Row], now: int) -> Iterator[Row]:
        held = self.held.get()
        step, seq, due = map(_local, held) if held is not None else (0, None, None)
        folded, waiting = self._released(self._facts(rows), now)
        ended: list[tuple] = []

        def run(facts: list[Row], seq, due):
            done = []
            for f in facts:
                if f["at"] is None or (f["kind"] not in self.sets and not self.cancels):
                    continue
                if due is not None:
                    done.append((seq, due, "fired" if f["at"] > due else "cancelled"))
                seq, due = (f["seq"], _after(f["at"], self.seconds)) if f["kind"] in self.sets else (None, None)
            return done, seq, due

        done, seq, due = run(folded, seq, due)
        ended += done
        if due is not None and _us(due) <= 1000 * now:
            ended.append((seq, due, "fired"))
            seq = due = None
        later, later_seq, later_due = run(waiting, seq, due)
        rows_out = [*ended, *later, *([(later_seq, later_due, "open")] if later_due is not None else [])]
        self._keep((step + len(rows_out), seq, due), waiting, due)
        for k, (own, at, status) in enumerate(rows_out):
            yield self._row(*key, step + k + 1, own, at, status)

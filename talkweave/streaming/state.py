"""State machines of the live system as plain steps: voice activity, silences, and turn-taking.

Each machine is a small class with `step(event) -> list of outputs` and a state that can be packed
into a tuple, so that the same code runs over a finished table and over a stream.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from talkweave.functions.vocab import INTERLOCUTOR, STOP_SPEAKING

WINDOW, RATE = 512, 16_000


@dataclass
class Voice:
    """Speech and silences from the voice probability of windows of 512 samples.

    Speech starts at `start`, goes on down to `leave`, and ends when it stays below for `pause`
    windows; the speech kept has one window before it and up to `after` windows behind it, and is
    dropped if shorter than `least` windows.  Every `silence` windows below `leave` give a silence,
    the rest of a longer run counts for the next; any other window sets the count back.
    """

    start: float = 0.5
    leave: float = 0.35
    pause: int = 1
    least: int = 5
    before: int = 1
    after: int = 2
    silence: int = 20
    at: int = 0
    quiet: int = 0
    since: int = -1
    size: int = 0
    end: int = 0

    def step(self, prob: float) -> list[tuple[str, int, int]]:
        """Outputs (kind, first sample, last sample) of one window."""
        out, here = [], self.at
        self.at += 1
        if prob < self.leave:
            self.quiet += 1
            if self.quiet >= self.silence:
                out.append(("silence", (self.at - self.silence) * WINDOW, self.at * WINDOW))
                self.quiet -= self.silence
        else:
            self.quiet = 0
        if self.since < 0:
            if prob >= self.start:
                lead = min(self.before, here)
                self.since, self.size, self.end = here - lead, lead + 1, 0
        else:
            self.size += 1
            if prob >= self.leave:
                self.end = 0
            else:
                self.end = self.end or self.size - 1
                if self.size - self.end >= self.pause:
                    if self.end >= self.least:
                        kept = min(self.end + self.after, self.size)
                        out.append(("speech", self.since * WINDOW, (self.since + kept) * WINDOW))
                    self.since, self.size, self.end = -1, 0, 0
        return out


@dataclass
class Leftover:
    """Chunks of any length cut into windows, what is left over carried to the next chunk."""

    kept: int = 0
    window: int = WINDOW

    def step(self, samples: int) -> int:
        """How many windows a chunk completes."""
        total = self.kept + samples
        self.kept = total % self.window
        return total // self.window


@dataclass
class WordSilence:
    """Silences by recognised words: given while listening, once the time since speech or the last silence is long enough."""

    unit_s: float = 0.64
    last: float = 0.0

    def step(self, now: float, spoke: bool, listening: bool) -> list[tuple[str, float, float]]:
        if spoke:
            self.last = now
            return []
        if listening and now - self.last >= self.unit_s:
            self.last = now
            return [("silence", now - self.unit_s, now)]
        return []


#: What may not follow in a state; yielding at once comes from simultaneous speech only.
FORBIDDEN = {"LISTEN": ["[S.LISTEN.INTERRUPT]", "[S.LISTEN.NATURAL]", "[C.SPEAK]"], "SPEAK": ["[S.SPEAK]", "[C.LISTEN]", "[S.LISTEN.INTERRUPT]"]}


def spliced(tape: list[str], target: int | None, split: int, decision: str, heard: str) -> tuple[list[str], str]:
    """The tape after speech arrived while the agent spoke, and the outcome.

    `target` is the entry being played, `split` the letters of it already heard.  CONTINUE keeps what
    is still to be said, INTERRUPT cuts the entry and drops what follows, NATURAL ends the entry and
    drops what follows; with nothing being played the speech is added at the end (NOPLAY).
    """
    new = INTERLOCUTOR + heard
    if target is None:
        return [*tape, new], "NOPLAY"
    head, entry = tape[:target], tape[target]
    said, rest = entry[:split], entry[split:]
    if decision == "[C.SPEAK]":
        return [*head, *([said] if said else []), new, decision, *([rest] if rest else []), *tape[target + 1 :]], "CONTINUE"
    if decision == "[S.LISTEN.INTERRUPT]":
        return [*head, *([said] if said else []), new, decision], "INTERRUPT"
    if decision == "[S.LISTEN.NATURAL]":
        return [*head, entry, new, decision], "NATURAL"
    raise ValueError(f"no decision: {decision}")


@dataclass
class Floor:
    """The turn-taking machine: a tape, a state, and clauses waiting to be played.

    Events are (kind, text, number): "heard" speech, with the letters of the playing clause heard so
    far; "played", a clause has ended; "generated", an entry from the model; "decision", what to do
    about speech heard while speaking.  The switch to listening waits until all clauses are played.
    """

    state: str = "LISTEN"
    tape: list[str] = field(default_factory=list)
    playing: list[int] = field(default_factory=list)
    waiting: list = field(default_factory=list)
    look_ahead: int = 2
    gone: int = 0

    def trim(self) -> list[str]:
        """Takes off and gives the entries that nothing can change any more: all before the one being played, but for the last."""
        n = max(0, min([len(self.tape) - 1, *self.playing]))
        done, self.tape = self.tape[:n], self.tape[n:]
        self.playing = [i - n for i in self.playing]
        self.gone += n
        return done

    def _settle(self) -> None:
        if self.state == "SPEAK" and self.tape and self.tape[-1] in STOP_SPEAKING and not self.playing:
            self.state = "LISTEN"

    def wants_more(self) -> bool:
        """Whether the model should go on: speaking, not at a turn's end, and fewer clauses waiting than it may look ahead."""
        return self.state == "SPEAK" and bool(self.tape) and self.tape[-1] not in STOP_SPEAKING and len(self.playing) < self.look_ahead

    def step(self, kind: str, text: str, number: int = 0) -> str:
        """Takes one event; gives what came of it."""
        outcome = kind
        if kind == "heard":
            if self.state == "SPEAK" and self.playing:
                self.waiting = [text, number]
                outcome = "judge"
            else:
                self.tape.append(INTERLOCUTOR + text)
                outcome = "NOPLAY" if self.state == "SPEAK" else "listen"
        elif kind == "decision" and self.waiting:
            heard, split = self.waiting
            before = len(self.tape)
            self.tape, outcome = spliced(self.tape, self.playing[0] if self.playing else None, split, text, heard)
            if outcome == "CONTINUE":  # entries behind the splice have moved
                moved = len(self.tape) - before
                self.playing = [i + moved for i in self.playing]
            elif outcome == "INTERRUPT":
                self.playing = []
            elif outcome == "NATURAL":
                self.playing = self.playing[:1]
            self.waiting = []
        elif kind == "played":
            self.playing = self.playing[1:]
        elif kind == "generated":
            if text in FORBIDDEN[self.state]:
                outcome = "forbidden"
            else:
                self.tape.append(text)
                if text == "[S.SPEAK]":
                    self.state = "SPEAK"
                elif not text.startswith("[") and self.state == "SPEAK":
                    self.playing.append(len(self.tape) - 1)
        self._settle()
        return outcome


@dataclass
class Playback:
    """A player's queue: START, AUDIO chunks and END of each clause, played in order.

    Events are (kind, clause, samples): "start" and "end" of a clause, "audio" for it, "tick" for time
    that passes, "interrupt", which drops everything at once, and "flush", after which nothing new is
    taken until the queue is empty.  Outputs are (what, clause, samples): "playing", "played", with the
    samples heard of the clause, "cut", with those heard so far, and "late" for audio that is not taken.
    """

    queue: list = field(default_factory=list)  # [clause, samples waiting, samples heard, whether its end is known]
    flushing: bool = False
    idle: int = 0

    def step(self, kind: str, clause: int = 0, samples: int = 0) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        mine = next((q for q in self.queue if q[0] == clause), None)
        if kind == "start":
            if self.flushing:
                return [("late", clause, 0)]
            self.queue.append([clause, 0, 0, False])
        elif kind == "audio":
            if mine is None or mine[3]:
                return [("late", clause, samples)]
            mine[1] += samples
        elif kind == "end" and mine is not None:
            mine[3] = True
        elif kind == "interrupt":
            out = [("cut", q[0], q[2]) for q in self.queue]
            self.queue, self.flushing = [], False
        elif kind == "flush":
            self.flushing = bool(self.queue)
        left = samples if kind == "tick" else 0
        self.idle = self.idle + samples if kind == "tick" and not self.queue else 0 if self.queue else self.idle
        while self.queue:
            head = self.queue[0]
            n = min(left, head[1])
            if n and not head[2]:
                out.append(("playing", head[0], 0))
            head[1], head[2], left = head[1] - n, head[2] + n, left - n
            if head[1] or not head[3]:
                break
            out.append(("played", head[0], head[2]))
            self.queue.pop(0)
        self.flushing = self.flushing and bool(self.queue)
        return out

    def settled(self, most: int) -> bool:
        """Whether nothing has been played for so many samples: a session may stop."""
        return not self.queue and self.idle >= most


def packed(machine) -> str:
    return json.dumps(asdict(machine))


def unpacked(kind, text: str):
    return kind(**json.loads(text))

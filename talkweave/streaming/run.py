"""State machines over tables and streams, late rows, incremental tails and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from talkweave.functions.vocab import INTERLOCUTOR, TRANSITIONS
from talkweave.operators.blocks import matched, runs
from talkweave.streaming.state import Floor, Playback, Voice, packed, unpacked

VOICE_OUT = "stream string, kind string, first long, last long"
FLOOR_OUT = "stream string, seq long, outcome string, state string, n_tape int"


def _voice_rows(stream: str, machine: Voice, probs) -> pd.DataFrame:
    out = [(stream, *o) for p in probs for o in machine.step(float(p))]
    return pd.DataFrame(out, columns=["stream", "kind", "first", "last"])


def voice_batch(windows: DataFrame) -> DataFrame:
    """Speech and silences of finished streams; `windows` has stream, idx and prob."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return _voice_rows(pdf["stream"].iloc[0], Voice(), pdf["prob"])

    return windows.groupBy("stream").applyInPandas(run, VOICE_OUT)


def _kept(state: GroupState, machine, idle: int | None) -> None:
    """Keeps a machine for the next batch, or until its stream has been silent for so many milliseconds."""
    state.update((packed(machine),))
    if idle is not None:
        state.setTimeoutDuration(idle)


def _timeout(idle: int | None) -> str:
    """None keeps state for good; a run over what is available now, which would wait for timeouts, needs that."""
    return GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout


def voice_stream(windows: DataFrame, idle: int | None = 3_600_000) -> DataFrame:
    """The same over a stream, the machine of each stream kept as state between batches, and dropped when idle."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = unpacked(Voice, state.get[0]) if state.exists else Voice()
        rows = pd.concat(list(parts)).sort_values("idx")
        yield _voice_rows(key[0], machine, rows["prob"])
        _kept(state, machine, idle)

    return windows.groupBy("stream").applyInPandasWithState(run, VOICE_OUT, "machine string", "append", _timeout(idle))


#: Judges speech heard while the agent speaks: from the tape and what was heard, the token to go on with.
Decide = Callable[[list[str], str], str]


def _floor_rows(stream: str, machine: Floor, rows: pd.DataFrame, decide: Decide | None = None) -> pd.DataFrame:
    out = []
    for seq, kind, text, number in zip(rows["seq"], rows["kind"], rows["text"], rows["number"]):
        outcome = machine.step(kind, text, int(number))
        if outcome == "judge" and decide is not None:
            outcome = machine.step("decision", decide(machine.tape, text))
        out.append((stream, seq, outcome, machine.state, machine.gone + len(machine.tape)))
    return pd.DataFrame(out, columns=["stream", "seq", "outcome", "state", "n_tape"])


def floor_batch(events: DataFrame, decide: Decide | None = None) -> DataFrame:
    """What came of every event of finished sessions; `events` has stream, seq, kind, text and number.

    With `decide` speech over the agent's is judged at once, without it by an event "decision".
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _floor_rows(pdf["stream"].iloc[0], Floor(), pdf.sort_values("seq"), decide)

    return events.groupBy("stream").applyInPandas(run, FLOOR_OUT)


def floor_stream(events: DataFrame, idle: int | None = 3_600_000, decide: Decide | None = None) -> DataFrame:
    """The same over a stream of events.  Of a tape only what may still change is kept as state, and that only until the session is idle."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine = unpacked(Floor, state.get[0]) if state.exists else Floor()
        yield _floor_rows(key[0], machine, pd.concat(list(parts)).sort_values("seq"), decide)
        machine.trim()
        _kept(state, machine, idle)

    return events.groupBy("stream").applyInPandasWithState(run, FLOOR_OUT, "machine string", "append", _timeout(idle))


PLAYED_OUT = "stream string, seq long, what string, clause int, samples long"


def playback_batch(events: DataFrame) -> DataFrame:
    """What a player did at every event of finished sessions; `events` has stream, seq, kind, clause and samples."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, out = Playback(), []
        for stream, seq, kind, clause, samples in pdf.sort_values("seq")[["stream", "seq", "kind", "clause", "samples"]].itertuples(index=False):
            out += [(stream, seq, *o) for o in machine.step(kind, int(clause), int(samples))]
        return pd.DataFrame(out, columns=["stream", "seq", "what", "clause", "samples"])

    return events.groupBy("stream").applyInPandas(run, PLAYED_OUT)


def silence_runs(windows: DataFrame, leave: float = 0.35, unit: int = 20, block: int = 100_000) -> DataFrame:
    """Silences by runs of windows below the threshold: stream, first window, windows, whole units; no state is needed once the run is known."""
    rows = windows.select("stream", "idx", F.col("idx").alias("seq"), (F.col("prob") < leave).alias("quiet"))
    found = runs(rows, ["stream"], "idx", "quiet", block, lambda: {"n": F.count("*")}, lambda: {"n": F.sum("n")})
    return found.where("quiet").select("stream", F.col("head.idx").alias("first"), "n", F.floor(F.col("n") / unit).alias("units"))


def snapshot(rows: DataFrame, key: str, ts: Column) -> DataFrame:
    """Adds t: seconds since the first row of the session, to four places.  The first is one aggregate a session, so a long session is spread."""
    timed = rows.withColumn("_ts", ts)
    first = timed.groupBy(key).agg(F.min("_ts").alias("_t0"))
    return matched(timed, first, [key], nulls=True).withColumn("t", F.round(F.col("_ts") - F.col("_t0"), 4)).drop("_ts", "_t0")


def entry_kind(token: Column) -> Column:
    """user, state or agent."""
    return F.when(token.isin(TRANSITIONS), "state").when(token.startswith(INTERLOCUTOR), "user").otherwise("agent")


def new_entries(entries: DataFrame, printed: DataFrame, key: str) -> DataFrame:
    """Entries after the last place already shown of their tape, with their kind; `printed` has the key and `upto`."""
    return entries.join(printed, key, "left").where(F.col("pos") > F.coalesce("upto", F.lit(-1))).select(key, "pos", "token", entry_kind(F.col("token")).alias("kind"))


def paced(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of JSON files as a stream, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def windowed_counts(events: DataFrame, ts: str, late: str = "10 minutes", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Events by window and type, a window every `slide`, closed once the watermark passes; rows later than that are not counted."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stamped.groupBy(F.window("_ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def with_late(batch: DataFrame, ts: str, watermark, sink_on_time, sink_late) -> None:
    """For foreachBatch: rows before the watermark, and rows without a time, go to the sink of late rows, the others on."""
    on_time = F.coalesce(F.col(ts) >= F.lit(watermark), F.lit(False))
    sink_late(batch.where(~on_time))
    sink_on_time(batch.where(on_time))

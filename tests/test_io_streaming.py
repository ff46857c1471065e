"""Sources and sinks as round trips, and streams equal to their batch forms."""

import json
import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from talkweave.sources import files as S
from talkweave.sources import sinks as K
from talkweave.streaming import run as R
from talkweave.streaming.state import FORBIDDEN, WINDOW, Floor, Leftover, Playback, Voice, WordSilence, spliced


def test_transcripts(spark, tmp_path):
    (tmp_path / "sw1A.text").write_text("sw1A 0.5 1.0 m[aybe]- so\n\nsw1A 1.0 2.0\nsw1A x 2.0 z\n")
    got = S.word_transcript(spark, str(tmp_path / "sw1A.text")).collect()
    assert [(r.start, r.end, r.text, r.clean) for r in got] == [(0.5, 1.0, "m[aybe]- so", "maybe- so")]
    (tmp_path / "fe1.txt").write_text("# comment\n\n1.5 2.5 A: ((well)) yes\n2.0 x B: no\n3.0 4.0 C: no\n1 2\n")
    got = S.utterance_transcript(spark, str(tmp_path / "fe1.txt")).collect()
    assert [(r.speaker_id, r.start, r.end, r.clean) for r in got] == [("A", 1.5, 2.5, "well yes")]
    assert [r.start for r in S.strict_lines(spark, str(tmp_path / "fe1.txt")).where("start IS NOT NULL").collect()] == [1.5, 3.0]


def test_json_sources(spark, tmp_path):
    (tmp_path / "c_A.json").write_text(json.dumps([["hi", 1.0, 1.1, 0.5, 0.9], ["<SIL>", 2.0, None, 1.0, 1.64]]))
    got = S.asr_json(spark, str(tmp_path / "c_A.json")).orderBy("seq").collect()
    assert [(r.text, r.audio_start, r.finish) for r in got] == [("hi", 0.5, 1.1), ("<SIL>", 1.0, None)]
    (tmp_path / "dump.json").write_text(json.dumps([{"id": "a", "conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}]))
    assert [(r.turn, r.role, r.value) for r in S.chats(spark, str(tmp_path / "dump.json")).collect()] == [(0, "human", "x"), (1, "gpt", "y")]
    (tmp_path / "done.jsonl").write_text('{"task_id": "t1", "prompt": "p", "raw_response": "r"}\n{broken\n{"task_id": "t2"}\n')
    assert {r.task_id for r in S.completed_ids(spark, str(tmp_path / "done.jsonl")).collect()} == {"t1", "t2"}
    assert S.json_lines(spark, str(tmp_path / "done.jsonl")).count() == 2
    (tmp_path / "calls.csv").write_text("c1,,,4,x" + "," * 10 + "z\nc2,,,5,3" + "," * 10 + "z\nshort,1,2\n")
    assert {tuple(r) for r in S.call_metadata(spark, str(tmp_path / "calls.csv")).collect()} == {("c1", 4, 0), ("c2", 5, 3)}


def test_scan_and_cache(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("sw1.json", "sw2.json", "note.txt", "x.json"):
        (tmp_path / "d" / n).write_text("{}")
    broken = spark.createDataFrame([("sw2",)], "call_id string")
    got = S.scan_files(spark, str(tmp_path), "*.json", r"^(sw\d+)", broken).collect()
    assert {(r.call_id, r.own, r.other) for r in got} == {("sw1", "A", "B"), ("sw1", "B", "A")}
    made = []
    for _ in range(2):
        assert S.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
    for n in ("law", "physics"):
        spark.range(2).write.parquet(str(tmp_path / "splits" / n))
    assert {r.split for r in S.splits(spark, str(tmp_path / "splits"), "law+physics").collect()} == {"law", "physics"}


def test_wav(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<hh", 1000, 3000) for _ in range(800)))
    r = S.wav_mono(spark, str(tmp_path)).first()
    assert len(r.samples) == 1600 and r.samples[5] == pytest.approx(2000 / 32768, abs=1e-6)


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([("a", "user", "train", ["x", "[S.SPEAK]"]), ("b", "assistant", "test", ["y"])], "id string, role string, split string, tape array<string>")
    for kind in ("json", "parquet"):
        K.by_role_and_split(t, str(tmp_path / kind), kind)
        assert {(r.id, r.role, r.split) for r in spark.read.format(kind).load(str(tmp_path / kind)).collect()} == {("a", "user", "train"), ("b", "assistant", "test")}
    for _ in range(2):
        K.append_records(t.select("id"), str(tmp_path / "log"))
        K.checkpoint_part(t.select("id"), str(tmp_path / "parts"), "1")
    assert spark.read.json(str(tmp_path / "log")).count() == 4 and spark.read.json(str(tmp_path / "parts")).count() == 2
    rows = spark.createDataFrame([("c", 1.0, 2.5, "A", "hi"), ("c", 3.0, 4.0, "B", "yo"), ("c", 5.0, 6.0, "B", " ")], "conv_id string, start double, end double, speaker string, text string")
    K.refined_transcript(rows, str(tmp_path / "text"), ["start"], "# kept")
    assert [r.value for r in spark.read.text(str(tmp_path / "text" / "conv_id=c")).collect()] == ["# kept", "", "1.00 2.50 A: hi", "", "3.00 4.00 B: yo"]
    K.results(spark.createDataFrame([("q_10",), ("q_9",), ("q",)], "id string"), str(tmp_path / "res"))
    assert {r.id for r in spark.read.json(str(tmp_path / "res")).collect()} == {"q_10", "q_9", "q"}
    assert [(r.bin, r.n) for r in K.chart_data(spark.range(100), "id", 4).orderBy("bin").collect()] == [(0, 25), (1, 25), (2, 25), (3, 25)]


def test_voice_rules():
    v = Voice()
    out = [o for p in [0.1] * 3 + [0.6] + [0.4] * 5 + [0.1] * 45 + [0.2, 0.9, 0.1] for o in v.step(p)]
    assert out[0] == ("speech", 2 * WINDOW, 10 * WINDOW)  # one window before, as many behind as there are
    assert [o for o in out if o[0] == "silence"] == [("silence", 9 * WINDOW, 29 * WINDOW), ("silence", 29 * WINDOW, 49 * WINDOW)]
    assert len(out) == 3  # the last speech is too short
    cut = Leftover()
    assert [cut.step(n) for n in (500, 12, 1023, 1)] == [0, 1, 1, 1] and cut.kept == 0
    w = WordSilence()
    assert [bool(w.step(t, s, k)) for t, s, k in [(0.5, False, True), (0.7, False, True), (1.0, True, True), (1.7, False, False), (1.8, False, True)]] == [False, True, False, False, True]


def test_splicing():
    tape = ["[S.SPEAK]", "the tall cook", "[C.SPEAK]", "waits"]
    assert spliced(tape, None, 0, "", "hm") == ([*tape, "<interlocutor>hm"], "NOPLAY")
    assert spliced(tape, 1, 8, "[C.SPEAK]", "hm")[0] == ["[S.SPEAK]", "the tall", "<interlocutor>hm", "[C.SPEAK]", " cook", "[C.SPEAK]", "waits"]
    assert spliced(tape, 1, 8, "[S.LISTEN.INTERRUPT]", "hm")[0] == ["[S.SPEAK]", "the tall", "<interlocutor>hm", "[S.LISTEN.INTERRUPT]"]
    assert spliced(tape, 1, 8, "[S.LISTEN.NATURAL]", "hm")[0] == ["[S.SPEAK]", "the tall cook", "<interlocutor>hm", "[S.LISTEN.NATURAL]"]


def test_floor():
    m = Floor()
    m.step("heard", "hi")
    assert m.step("generated", "[C.SPEAK]") == "forbidden" and "[C.SPEAK]" in FORBIDDEN["LISTEN"]
    m.step("generated", "[S.SPEAK]")
    m.step("generated", "one")
    assert m.wants_more()
    m.step("generated", "[C.SPEAK]")
    m.step("generated", "two")
    assert not m.wants_more()
    m.step("generated", "[S.LISTEN.NATURAL]")
    assert m.state == "SPEAK"  # two clauses are still to be played
    m.step("played", "")
    m.step("played", "")
    assert m.state == "LISTEN"


def test_trimmed_tapes_go_on_alike():
    rng = random.Random(4)
    for _ in range(50):
        whole, short, gone = Floor(), Floor(), []
        for _ in range(80):
            kind = rng.choice(["heard", "generated", "generated", "played", "decision"])
            text = "[C.SPEAK]" if kind == "decision" else rng.choice(["[S.SPEAK]", "some words", "[C.SPEAK]", "[S.LISTEN.NATURAL]"])
            assert whole.step(kind, text, 2) == short.step(kind, text, 2) and whole.state == short.state
            gone += short.trim() if rng.random() < 0.3 else []
            assert gone + short.tape == whole.tape and short.gone == len(gone)
        assert len(short.tape) <= len(whole.tape)


def test_decide_hook(spark):
    """Speech over the agent's is judged at once: yield to "stop", go on with anything else."""
    rows = [("a", 1, "generated", "[S.SPEAK]", 0), ("a", 2, "generated", "the long sentence", 0), ("a", 3, "heard", "uh-huh", 3), ("a", 4, "heard", "stop", 5), ("a", 5, "heard", "thanks", 0)]
    df = spark.createDataFrame(rows, "stream string, seq long, kind string, text string, number int")
    decide = lambda tape, heard: "[S.LISTEN.INTERRUPT]" if heard == "stop" else "[C.SPEAK]"
    got = [(r.outcome, r.state) for r in R.floor_batch(df, decide).orderBy("seq").collect()]
    assert got == [("generated", "SPEAK"), ("generated", "SPEAK"), ("CONTINUE", "SPEAK"), ("INTERRUPT", "LISTEN"), ("listen", "LISTEN")]


def test_playback():
    p = Playback()
    assert p.step("start", 1) == [] and p.step("audio", 1, 100) == []
    assert p.step("start", 2) == [] and p.step("audio", 2, 50) == [] and p.step("end", 1) == []
    assert p.step("tick", 0, 60) == [("playing", 1, 0)]
    assert p.step("tick", 0, 60) == [("played", 1, 100), ("playing", 2, 0)]
    assert p.step("flush") == [] and p.step("start", 3) == [("late", 3, 0)] and p.step("audio", 3, 5) == [("late", 3, 5)]
    assert p.step("end", 2) == [] and p.step("tick", 0, 30) == [("played", 2, 50)]
    assert not p.flushing and p.step("start", 4) == [] and p.step("audio", 4, 10) == [] and p.step("tick", 0, 4) == [("playing", 4, 0)]
    assert p.step("interrupt") == [("cut", 4, 4)] and p.queue == []
    assert not p.settled(1) and p.step("tick", 0, 500) == [] and p.settled(500)


def test_late_rows_and_rows_without_time(spark):
    df = spark.createDataFrame([(1, 5), (2, 20), (3, None)], "k int, t int")
    got = {}
    R.with_late(df, "t", 10, lambda d: got.update(on=[r.k for r in d.collect()]), lambda d: got.update(late=[r.k for r in d.collect()]))
    assert got["on"] == [2] and sorted(got["late"]) == [1, 3]


def _streamed(spark, tmp_path, rows, schema, make, name, size=150):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(0, len(rows), size):
        (folder / f"{k:05}.json").write_text("\n".join(json.dumps(r) for r in rows[k : k + size]))
        import os

        os.utime(folder / f"{k:05}.json", (1_600_000_000 + k, 1_600_000_000 + k))
    q = make(R.paced(spark, str(folder), schema)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(2)
    prob, rows = 0.1, []
    for k in range(200):
        prob = rng.choice([prob, prob, prob, 0.1, 0.4, 0.8])
        rows += [{"stream": s, "idx": k, "prob": prob if s == "a" else 0.9 - prob} for s in ("a", "b")]
    batch = R.voice_batch(spark.createDataFrame([(r["stream"], r["idx"], r["prob"]) for r in rows], "stream string, idx long, prob double"))
    assert _streamed(spark, tmp_path, rows, "stream string, idx long, prob double", lambda df: R.voice_stream(df, None), "voice") == {tuple(r) for r in batch.collect()} != set()


def test_floor_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"stream": s, "seq": k, "kind": rng.choice(["heard", "generated", "generated", "played", "decision"]), "text": rng.choice(["[S.SPEAK]", "some words", "[C.SPEAK]", "[S.LISTEN.NATURAL]"]), "number": 2} for k in range(120) for s in ("a", "b")]
    rows = [dict(r, text="[C.SPEAK]") if r["kind"] == "decision" else r for r in rows]
    schema = "stream string, seq long, kind string, text string, number int"
    batch = R.floor_batch(spark.createDataFrame([tuple(r.values()) for r in rows], schema))
    assert _streamed(spark, tmp_path, rows, schema, lambda df: R.floor_stream(df, None), "floor") == {tuple(r) for r in batch.collect()}


def test_watermark_drops_late_rows(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T00:{m:02}:00", "event_type": "x"} for m in range(40)] + [{"ts": "2024-01-01T00:39:00", "event_type": "x"}] * 40 + [{"ts": "2024-01-01T00:01:30", "event_type": "x"}] * 40 + [{"ts": "2024-01-01T02:00:00", "event_type": "x"}] * 40
    got = _streamed(spark, tmp_path, rows, "ts timestamp, event_type string", lambda df: R.windowed_counts(df, "ts"), "windows", 40)
    counts = {r[0].minute: r[2] for r in got if r[0].hour == 0}
    assert counts[0] == 5 and counts[5] == 5


def test_snapshot_and_tail(spark):
    df = spark.createDataFrame([("a", 0, "[S.SPEAK]", 5.0), ("a", 1, "x", 5.12345), ("b", 0, "<interlocutor>y", 1.0)], "id string, pos int, token string, ts double")
    assert sorted(r.t for r in R.snapshot(df, "id", F.col("ts")).collect()) == [0.0, 0.0, 0.1235] or sorted(r.t for r in R.snapshot(df, "id", F.col("ts")).collect()) == [0.0, 0.0, 0.1234]
    shown = spark.createDataFrame([("a", 0)], "id string, upto int")
    assert {(r.id, r.kind) for r in R.new_entries(df, shown, "id").collect()} == {("a", "agent"), ("b", "user")}

"""Queries of joins, as-of lookups and shared timelines, over calls, events and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.operators import joins as J
from talkweave.plans import timeline
from talkweave.sources.files import TableReader
from talkweave.sources.tables import table


def partner_semi(spark, folder):
    """Calls whose callers also called each other the other way round; a call of a caller to itself is its own other way, a call without a caller has none."""
    c = table(spark, folder, "call_meta").select("call_id", F.col("caller_a").alias("a"), F.col("caller_b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    return J.both_directions(c.withColumn("all", F.lit(0)), "all", "a", "b").select("call_id", "a", "b")


def quality_left(spark, folder):
    """Streams with both grades of their call, 0 where a grade is no number, and whether both are at least 3."""
    grade = lambda c: F.coalesce(F.expr(f"try_cast(CASE WHEN {c} RLIKE '^[0-9]+$' THEN {c} END AS INT)"), F.lit(0))
    q = table(spark, folder, "call_meta").groupBy(F.col("call_id").alias("conv_id")).agg(F.max(grade("sig_grade")).alias("sig"), F.max(grade("cnv_grade")).alias("cnv"))
    s = table(spark, folder, "trans_stream").groupBy("conv_id").agg(F.count_distinct("seq").alias("n_lines"))
    sig, cnv = F.coalesce("sig", F.lit(0)), F.coalesce("cnv", F.lit(0))
    return s.join(q, "conv_id", "left").select("conv_id", "n_lines", sig.alias("sig"), cnv.alias("cnv"), ((sig >= 3) & (cnv >= 3)).alias("good"))


def bad_ids_anti(spark, folder):
    """Calls that are not on the list of broken ones; the list joins as its size allows."""
    return table(spark, folder, "call_meta").select("call_id").distinct().join(table(spark, folder, "bad_ids").distinct(), "call_id", "left_anti")


def direction_files(spark, folder):
    """Both directions of every call that is not broken, named after their speakers."""
    directions = F.explode(F.array(F.struct(F.lit("A").alias("own"), F.lit("B").alias("other")), F.struct(F.lit("B").alias("own"), F.lit("A").alias("other"))))
    return bad_ids_anti(spark, folder).select("call_id", directions.alias("d")).select(F.concat_ws("_", "call_id", "d.own", F.lit("to"), "d.other").alias("name"), "d.own", "d.other")


def kept_calls(spark, folder):
    """Calls that a reader of tables gives, with their recognised pieces and transcript lines."""
    r = TableReader(spark, folder)
    count = lambda df, n: df.groupBy("conv_id").agg(F.count_distinct("seq").alias(n))
    ids = r.calls().select(F.col("call_id").alias("conv_id")).distinct()
    return ids.join(count(r.heard(), "n_heard"), "conv_id", "left").join(count(r.said(), "n_said"), "conv_id", "left").na.fill(0, ["n_heard", "n_said"])


def resume_anti(spark, folder):
    """Chats that have not come to their fourth turn yet."""
    t = table(spark, folder, "conversation_turn")
    return J.remaining(t.select("id").distinct(), t.where("turn = 3"), ["id"])


def cache_lookup(spark, folder):
    """Every call of the list with the cached recognition of its first piece, null where none is cached."""
    first = table(spark, folder, "asr_stream").groupBy(F.col("conv_id").alias("call_id")).agg(F.min_by("text", F.struct("seq", "receive")).alias("cached"))
    return J.cached(table(spark, folder, "call_meta").select("call_id").distinct(), first, "call_id")


def transcript_pairs(spark, folder):
    """Calls by whether each stream is there."""
    a = table(spark, folder, "asr_stream").groupBy("conv_id").agg(F.count_distinct("seq").alias("n_asr"))
    t = table(spark, folder, "trans_stream").groupBy("conv_id").agg(F.count_distinct("seq").alias("n_trans"))
    return a.join(t, "conv_id", "full").select("conv_id", F.coalesce("n_asr", F.lit(0)).alias("n_asr"), F.coalesce("n_trans", F.lit(0)).alias("n_trans"))


def asof_progress(spark, folder):
    """For every purchase the last click of its user at or before it, and its value."""
    e = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type", "value")
    left, right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'click'")
    joined = J.as_of(left, right.groupBy("user_id", "ts").agg(F.max("value").alias("value")), "user_id", "ts", F.col("value"), "last_value")
    return joined.select("event_id", "user_id", F.round("last_value", 6).alias("last_value"))


def clause_progress(spark, folder):
    """Which transcript line covers the start of each recognised piece of its call, and how far it was spoken, in letters."""
    lines = timeline._lines(spark, folder).groupBy("conv_id", "start").agg(F.max(F.struct("seq", "end", "text")).alias("l"))
    pieces = timeline.words(spark, folder).select("conv_id", (F.col("s") / 10000).alias("start"), F.col("seq").alias("piece"))
    got = J.as_of(pieces, lines, "conv_id", "start", F.struct(F.col("start").alias("began"), "l"), "x", 300.0)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("start") - F.col("x.began"), F.col("x.l.end") - F.col("x.began"))))
    return got.where("x IS NOT NULL").select("conv_id", "piece", F.col("x.l.seq").alias("line"), F.floor(F.coalesce(share, F.lit(1.0)) * F.length("x.l.text")).cast("int").alias("letters"))


def tape_locate(spark, folder):
    """Each line's place by its exact start, else by its text, the last that fits."""
    t = timeline._lines(spark, folder)
    requests = t.select("conv_id", "seq", F.when(F.col("seq") % 3 == 0, F.lit(-1.0)).otherwise(F.col("start")).alias("start"), "text")
    return J.located(requests, t.select("conv_id", "start", "text", F.col("seq").alias("pos")), "conv_id", "start", "text", "pos").select("conv_id", "seq", "found")


def overlay_track(spark, folder):
    """Embeddings as chunks of samples, added up on a track per label that ends at sample 2,000."""
    e = table(spark, folder, "embeddings").select("label", (F.col("vec_id") % 211 * 10).alias("at"), F.transform("embedding", lambda x: F.round(x * 1000).cast("long")).alias("chunk"))
    return J.overlaid(e, "label", "at", "chunk", F.lit(2000))


def shared_timeline(spark, folder):
    """Events a minute of two kinds on one timeline, 0 where one has none."""
    e = table(spark, folder, "events")
    per = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.date_trunc("minute", "ts").cast("string").alias("minute")).agg(F.count("*").cast("double").alias("n"))
    return J.aligned(per(0), per(1), ["minute"], "n")


def weights_lookup(spark, folder):
    """Targets of every mix joined to how many documents their source has."""
    n = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n_docs"))
    return table(spark, folder, "mix_targets").join(n, "source", "left").select("mix_id", "source", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def json_extraction(spark, folder):
    """The number in an event's properties; null if they hold none or are no JSON."""
    return table(spark, folder, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"))


def set_operations(spark, folder):
    """Call ids of either stream: in both, in one only."""
    a, t = (table(spark, folder, n).select("conv_id").distinct() for n in ("asr_stream", "trans_stream"))
    tag = lambda df, name: df.select(F.lit(name).alias("kind"), "conv_id")
    return tag(a.intersect(t), "both").unionByName(tag(a.exceptAll(t), "asr")).unionByName(tag(t.exceptAll(a), "trans"))


def revenue_rollup(spark, folder):
    """Revenue by nation and year with totals: the star schema joined, pruned and rolled up."""
    li, o, c, n = (table(spark, folder, x) for x in ("lineitem", "orders", "customer", "nation"))
    value = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double")
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
        .rollup("n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(value), 2).alias("revenue"), F.count("*").alias("n"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        partner_semi, quality_left, bad_ids_anti, direction_files, kept_calls, resume_anti, cache_lookup, transcript_pairs, asof_progress, clause_progress, tape_locate, overlay_track, shared_timeline,
        weights_lookup, json_extraction, set_operations, revenue_rollup,
    )
}

SQL = {
    "partner_semi": """WITH c AS (SELECT DISTINCT call_id, caller_a AS a, caller_b AS b FROM call_meta WHERE caller_a IS NOT NULL AND caller_b IS NOT NULL)
      SELECT call_id, a, b FROM c x WHERE EXISTS (SELECT 1 FROM c y WHERE y.a = x.b AND y.b = x.a)""",
    "quality_left": """WITH q AS (SELECT call_id, max(CASE WHEN regexp_matches(sig_grade, '^[0-9]+$') THEN CAST(sig_grade AS INTEGER) ELSE 0 END) AS sig, max(CASE WHEN regexp_matches(cnv_grade, '^[0-9]+$') THEN CAST(cnv_grade AS INTEGER) ELSE 0 END) AS cnv FROM call_meta GROUP BY call_id),
      s AS (SELECT conv_id, count(DISTINCT seq) AS n_lines FROM trans_stream GROUP BY conv_id)
      SELECT conv_id, n_lines, coalesce(sig, 0) AS sig, coalesce(cnv, 0) AS cnv, coalesce(sig, 0) >= 3 AND coalesce(cnv, 0) >= 3 AS good FROM s LEFT JOIN q ON call_id = conv_id""",
    "bad_ids_anti": "SELECT DISTINCT call_id FROM call_meta WHERE call_id NOT IN (SELECT call_id FROM bad_ids)",
    "direction_files": "WITH c AS (SELECT DISTINCT call_id FROM call_meta WHERE call_id NOT IN (SELECT call_id FROM bad_ids)) SELECT call_id || '_' || own || '_to_' || other AS name, own, other FROM c, (VALUES ('A', 'B'), ('B', 'A')) d(own, other)",
    "kept_calls": """SELECT c.call_id AS conv_id, coalesce(a.n, 0) AS n_heard, coalesce(t.n, 0) AS n_said FROM (SELECT DISTINCT call_id FROM call_meta WHERE call_id NOT IN (SELECT call_id FROM bad_ids)) c
      LEFT JOIN (SELECT conv_id, count(DISTINCT seq) AS n FROM asr_stream GROUP BY 1) a ON a.conv_id = c.call_id LEFT JOIN (SELECT conv_id, count(DISTINCT seq) AS n FROM trans_stream GROUP BY 1) t ON t.conv_id = c.call_id""",
    "resume_anti": "SELECT DISTINCT id FROM conversation_turn WHERE id NOT IN (SELECT id FROM conversation_turn WHERE turn = 3)",
    "cache_lookup": "SELECT call_id, cached FROM (SELECT DISTINCT call_id FROM call_meta) LEFT JOIN (SELECT conv_id, arg_min(text, (seq, receive)) AS cached FROM (SELECT conv_id, seq, receive, text FROM asr_stream WHERE text IS NOT NULL OR true) GROUP BY conv_id) ON conv_id = call_id",
    "transcript_pairs": """WITH a AS (SELECT conv_id, count(DISTINCT seq) AS n FROM asr_stream GROUP BY 1), t AS (SELECT conv_id, count(DISTINCT seq) AS n FROM trans_stream GROUP BY 1)
      SELECT coalesce(a.conv_id, t.conv_id) AS conv_id, coalesce(a.n, 0) AS n_asr, coalesce(t.n, 0) AS n_trans FROM a FULL JOIN t ON a.conv_id = t.conv_id""",
    "asof_progress": """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
      SELECT l.event_id, l.user_id, round(v.value, 6) AS last_value FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.ts""",
    "clause_progress": timeline.RECORDS + timeline._LINES.replace("WITH ln", ", ln") + """, lx AS (SELECT conv_id, start, arg_max(seq, seq) AS seq, arg_max("end", seq) AS "end", arg_max(text, seq) AS text FROM line GROUP BY conv_id, start),
      p AS (SELECT conv_id, s / 10000 AS start, seq AS piece FROM w)
      SELECT p.conv_id, p.piece, x.seq AS line, CAST(floor(coalesce(least(1.0, greatest(0.0, (p.start - x.start) / nullif(x."end" - x.start, 0))), 1.0) * length(x.text)) AS INTEGER) AS letters
      FROM p ASOF JOIN lx x ON p.conv_id = x.conv_id AND p.start >= x.start""",
    "tape_locate": timeline._LINES + """, h AS (SELECT conv_id, start, max(seq) AS p FROM line GROUP BY 1, 2), t AS (SELECT conv_id, text, max(seq) AS p FROM line GROUP BY 1, 2)
      SELECT l.conv_id, l.seq, coalesce(h.p, t.p) AS found FROM line l LEFT JOIN h ON h.conv_id = l.conv_id AND l.seq % 3 <> 0 AND h.start = l.start LEFT JOIN t ON t.conv_id = l.conv_id AND t.text = l.text""",
    "overlay_track": """WITH c AS (SELECT label, vec_id % 211 * 10 AS a0, unnest(range(len(embedding))) AS p, unnest(embedding) AS x FROM embeddings)
      SELECT label, a0 + p AS sample, CAST(sum(CAST(round(CAST(x * 1000 AS FLOAT)) AS BIGINT)) AS BIGINT) AS value FROM c WHERE a0 + p < 2000 GROUP BY 1, 2""",
    "shared_timeline": """WITH a AS (SELECT date_trunc('minute', ts) AS m, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT date_trunc('minute', ts) AS m, CAST(count(*) AS DOUBLE) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)
      SELECT strftime(coalesce(a.m, b.m), '%Y-%m-%d %H:%M:%S') AS minute, coalesce(a.n, 0) AS left_value, coalesce(b.n, 0) AS right_value FROM a FULL JOIN b ON a.m = b.m""",
    "weights_lookup": "SELECT mix_id, m.source, target_share, coalesce(n, 0) AS n_docs FROM mix_targets m LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) d ON d.source = m.source",
    "json_extraction": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "set_operations": """WITH a AS (SELECT DISTINCT conv_id FROM asr_stream), t AS (SELECT DISTINCT conv_id FROM trans_stream)
      SELECT CASE WHEN a.conv_id IS NULL THEN 'trans' WHEN t.conv_id IS NULL THEN 'asr' ELSE 'both' END AS kind, coalesce(a.conv_id, t.conv_id) AS conv_id FROM a FULL JOIN t ON a.conv_id = t.conv_id""",
    "revenue_rollup": """SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(CAST(l_extendedprice * (1 - l_discount) AS DOUBLE)), 2) AS revenue, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, year(o_orderdate))""",
}

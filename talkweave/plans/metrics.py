"""Queries of evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions.text import clean_switchboard, n_words, words
from talkweave.functions.vocab import SILENCE
from talkweave.operators import metrics as M
from talkweave.operators import timeline as T
from talkweave.operators.trainset import argmax
from talkweave.plans import chat, timeline
from talkweave.sources.tables import table


def _rates(spark, folder):
    """Turns against a hypothesis that loses every fifth word and garbles every seventh."""
    garbled = F.filter(F.transform(words(F.col("value")), lambda w, i: F.when(i % 5 == 4, F.lit("")).when(i % 7 == 6, F.concat(w, F.lit("x"))).otherwise(w)), lambda w: w != "")
    t = chat.turns(spark, folder).withColumn("hyp", F.array_join(garbled, " "))
    return t.select("id", "turn", M.word_error_rate(F.col("value"), F.col("hyp")).alias("wer")).where("wer IS NOT NULL")


def wer(spark, folder):
    return _rates(spark, folder).select("id", "turn", F.round("wer", 9).alias("wer"))


def wer_summary(spark, folder):
    return M.error_summary(_rates(spark, folder))


def wer_gate(spark, folder):
    """Turns of chats in which no turn's rate is above the gate."""
    rates = _rates(spark, folder)
    bad = rates.where("wer > 0.34").select("id").distinct()
    return rates.join(bad, "id", "left_anti").select("id", "turn")


def transcript_wer(spark, folder):
    """Recognised speech against transcripts: word errors and their rate per call and speaker, and whether the call passes the gate.

    Both sides are compared in blocks of five minutes, in which a word belongs to the block it starts
    in, so that the distance of a long call is a sum of short ones; shorter calls are compared whole.
    """
    block = F.floor(F.col("start") / 300).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda x: x.text), " ")
    heard = T.asr_records(table(spark, folder, "asr_stream")).where(F.col("text") != SILENCE)
    said = T.named_speakers(timeline._lines(spark, folder)).withColumn("text", clean_switchboard(F.col("text")))
    sides = [d.where("spk IS NOT NULL").groupBy("conv_id", "spk", block.alias("block")).agg(text.alias(n)) for d, n in ((heard, "hyp"), (said, "ref"))]
    e = sides[0].join(sides[1], ["conv_id", "spk", "block"], "full").na.fill("", ["hyp", "ref"])
    counted = e.select("conv_id", "spk", M.word_errors(F.col("ref"), F.col("hyp")).alias("errors"), F.size(words(M.comparable(F.col("ref")))).alias("n"))
    rate = F.try_divide(F.sum("errors").cast("double"), F.sum("n"))
    return counted.groupBy("conv_id", "spk").agg(F.sum("errors").alias("errors"), F.sum("n").alias("n_words"), F.round(rate, 9).alias("wer"), (rate <= 0.3).alias("passes"))


def _predictions(spark, folder):
    """Embeddings as logits: the true class of six, the class predicted, the mask (0: not counted) and the sample."""
    pred = (argmax(F.col("embedding")) % 6 + 1).alias("pred")
    label = (F.col("label") % 6 + 1).cast("int")
    return table(spark, folder, "embeddings").select("vec_id", (F.col("vec_id") % 20).alias("sample"), (F.col("vec_id") % 3).alias("dataset"), label.alias("label"), F.when(F.col("vec_id") % 11 == 0, 0).otherwise(label).alias("mask"), pred)


def confusion_matrix(spark, folder):
    return M.confusion(_predictions(spark, folder), "label", "pred")


def confusion_wide(spark, folder):
    counts = M.confusion(_predictions(spark, folder), "label", "pred")
    return M.confusion_wide(counts, [1, 2, 3, 4, 5, 6]).select("true", *[F.col(str(k)).alias(f"p{k}") for k in range(1, 7)])


def class_f1(spark, folder):
    return M.with_f1(M.class_counts(_predictions(spark, folder), ["dataset"], [2, 3, 4, 5, 6]))


def prf1_macro(spark, folder):
    """Means over classes per dataset, and the plain mean of the datasets."""
    per = M.macro(class_f1(spark, folder), ["dataset"]).withColumn("dataset", F.col("dataset").cast("string"))
    return per.unionByName(per.agg(F.lit("mean").alias("dataset"), *[F.round(F.avg(c), 9).alias(c) for c in ("precision", "recall", "f1")]))


def per_sample_f1(spark, folder):
    return M.macro(M.with_f1(M.class_counts(_predictions(spark, folder), ["sample"], [2, 3, 4, 5, 6])), ["sample"])


def _probes(spark, folder):
    """Chats as probes: every turn is a target, the response follows from the length of the turn."""
    n = F.length("value") % 4
    response = F.when(n == 0, "[C.LISTEN]").when(n == 1, "[S.SPEAK]").when(n == 2, "[S.LISTEN.INTERRUPT]").otherwise("[C.SPEAK]")
    return chat.turns(spark, folder).select("id", F.when(F.substring("id", -1, 1).isin(list("02468")), "MiU").otherwise("UiM").alias("kind"), F.col("turn").alias("target"), response.alias("response"), n_words(F.col("value")).alias("n"))


def interruption_outcomes(spark, folder):
    return M.outcomes(_probes(spark, folder))


def interruption_metrics(spark, folder):
    """Metrics with scores that stand in for a judge's: the words of the first acted turn, modulo 2 and 5."""
    probes = _probes(spark, folder)
    d = M.outcomes(probes)
    first = d.where("first_hit IS NOT NULL").select("id", F.col("first_hit").alias("target"), (F.col("mid_hit") == 0).alias("at_end"))
    judged = probes.join(first, ["id", "target"]).select("id", "kind", F.substring("id", -1, 1).alias("reason"), "at_end", (F.col("n") % 2).cast("double").alias("score"), (F.col("n") % 5).cast("double").alias("content"))
    return M.interruption_metrics(d, judged)


def subset_rollup(spark, folder):
    name = F.when(F.col("source") == "synthetic", "advbench").otherwise(F.col("source"))
    return M.rolled_up(table(spark, folder, "documents").where("source IS NOT NULL").select(name.alias("subset"), (F.col("n_chars") % 101 / 100).alias("score")), "subset", "score")


def cost_report(spark, folder):
    return M.generation_cost(table(spark, folder, "documents"), "n_chars", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (wer, wer_summary, wer_gate, transcript_wer, confusion_matrix, confusion_wide, class_f1, prf1_macro, per_sample_f1, interruption_outcomes, interruption_metrics, subset_rollup, cost_report)
}

_PRED = """WITH p AS (SELECT vec_id, vec_id % 20 AS sample, vec_id % 3 AS dataset, CAST(label % 6 + 1 AS INTEGER) AS label, CAST(CASE WHEN vec_id % 11 = 0 THEN 0 ELSE label % 6 + 1 END AS INTEGER) AS mask,
    CAST((list_position(embedding, list_max(embedding)) - 1) % 6 + 1 AS INTEGER) AS pred FROM embeddings)"""


def _f1_sql(key: str) -> str:
    return _PRED + f""", k AS (SELECT {key}, unnest([2, 3, 4, 5, 6]) AS class, label, mask, pred FROM p WHERE mask <> 0),
      c AS (SELECT {key}, class, count(*) FILTER (WHERE mask = class AND pred = label) AS tp, count(*) FILTER (WHERE pred = class AND mask <> class) AS fp, count(*) FILTER (WHERE mask = class AND pred <> label) AS fn
        FROM k GROUP BY {key}, class HAVING count(*) FILTER (WHERE mask = class OR pred = class) > 0),
      q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c),
      f AS (SELECT {key}, class, tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1 FROM q)"""


_PROBES = chat.TURNS + r""", pr AS (SELECT id, CASE WHEN right(id, 1) IN ('0', '2', '4', '6', '8') THEN 'MiU' ELSE 'UiM' END AS kind, turn AS target,
    CASE length(value) % 4 WHEN 0 THEN '[C.LISTEN]' WHEN 1 THEN '[S.SPEAK]' WHEN 2 THEN '[S.LISTEN.INTERRUPT]' ELSE '[C.SPEAK]' END AS response,
    len(list_filter(string_split_regex(value, '\s+'), lambda w: w <> '')) AS n FROM turns),
  hit AS (SELECT *, CASE WHEN kind = 'MiU' THEN response <> '[C.LISTEN]' ELSE starts_with(response, '[S.LISTEN') END AS hit, target = max(target) OVER (PARTITION BY id) AS at_end FROM pr),
  oc AS (SELECT id, kind, count(*) FILTER (WHERE hit AND NOT at_end) AS mid_hit, count(*) FILTER (WHERE hit AND at_end) AS end_hit, count(*) FILTER (WHERE NOT hit) AS miss, min(target) FILTER (WHERE hit) AS first_hit FROM hit GROUP BY id, kind),
  d AS (SELECT *, CASE WHEN mid_hit > 0 THEN 'mid' WHEN end_hit > 0 THEN 'end' ELSE 'miss' END AS outcome FROM oc)"""
SQL = {
    "confusion_matrix": _PRED + " SELECT label AS true, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 9) AS share FROM p GROUP BY label, pred",
    "confusion_wide": _PRED + " SELECT label AS true, " + ", ".join(f"count(*) FILTER (WHERE pred = {k}) AS p{k}" for k in range(1, 7)) + " FROM p GROUP BY label",
    "class_f1": _f1_sql("dataset") + " SELECT * FROM f",
    "prf1_macro": _f1_sql("dataset") + """, m AS (SELECT CAST(dataset AS VARCHAR) AS dataset, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM f GROUP BY dataset)
      SELECT * FROM m UNION ALL SELECT 'mean', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM m""",
    "per_sample_f1": _f1_sql("sample") + " SELECT sample, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM f GROUP BY sample",
    "interruption_outcomes": _PROBES + " SELECT * FROM d",
    "interruption_metrics": _PROBES + """, rt AS (SELECT kind, count(*) FILTER (WHERE outcome = 'mid') / count(*) AS mid, count(*) FILTER (WHERE outcome = 'end') / count(*) AS e, count(*) FILTER (WHERE outcome = 'miss') / count(*) AS miss FROM d GROUP BY kind),
      j AS (SELECT p.id, p.kind, right(p.id, 1) AS reason, d.mid_hit = 0 AS at_end, p.n % 2 AS score, p.n % 5 AS content FROM pr p JOIN d ON p.id = d.id AND p.target = d.first_hit),
      s AS (SELECT coalesce(avg(score) FILTER (WHERE kind = 'MiU' AND NOT at_end), 0) AS pir, avg(content) FILTER (WHERE kind = 'MiU' AND NOT at_end) AS prr, avg(score) FILTER (WHERE kind = 'UiM') AS uim FROM j),
      m AS (SELECT pir * mid + e AS p, 1 - miss AS r FROM rt, s WHERE kind = 'MiU'),
      al AS (SELECT kind || '_ir_mid' AS name, mid AS value FROM rt UNION ALL SELECT kind || '_ir_end', e FROM rt UNION ALL SELECT kind || '_MIR', miss FROM rt
        UNION ALL SELECT 'MiU_PIR_mid', pir FROM s UNION ALL SELECT 'UiM_PRR_avg', uim FROM s UNION ALL SELECT 'MiU_PRR_mid', prr FROM s
        UNION ALL SELECT 'MiU_Precision', p FROM m UNION ALL SELECT 'MiU_Recall', r FROM m UNION ALL SELECT 'MiU_F1', coalesce(2 * p * r / nullif(p + r, 0), 0) FROM m
        UNION ALL SELECT 'UiM_PRR_' || reason, avg(score) FROM j WHERE kind = 'UiM' GROUP BY reason)
      SELECT name, round(value, 9) AS value FROM al WHERE value IS NOT NULL""",
    "subset_rollup": """WITH s AS (SELECT CASE WHEN source = 'synthetic' THEN 'advbench' ELSE source END AS subset, avg(n_chars % 101 / 100) AS score FROM documents WHERE source IS NOT NULL GROUP BY 1),
      t AS (SELECT subset, CASE WHEN subset = 'advbench' THEN score * 100 ELSE score END AS score FROM s)
      SELECT subset, round(score, 6) AS score FROM t UNION ALL SELECT 'overall', round(avg(score), 6) FROM t""",
    "cost_report": "SELECT CAST(sum(n_chars) AS BIGINT) AS tokens_in, CAST(sum(doc_id) AS BIGINT) AS tokens_out, round(sum(n_chars) / 1e6 * 10.0 + sum(doc_id) / 1e6 * 30.0, 9) AS cost FROM documents",
}

"""Queries that prepare training rows: token statistics, slices, packing, budgets, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkweave.functions.text import n_words
from talkweave.functions.vocab import TRANSITIONS
from talkweave.operators import sampling as S
from talkweave.operators import trainset as N
from talkweave.plans import chat, tape
from talkweave.sources.tables import table

#: Response and transition weights by dataset id.
WEIGHTS = [(0, 1.0, 1.0), (1, 0.5, 2.0), (2, 2.0, 0.5)]


def _tokens(spark, folder):
    return N.token_rows(tape.entries(spark, folder), "id")


def token_masks(spark, folder):
    """Tokens of every tape by mask."""
    return _tokens(spark, folder).groupBy("id", "mask").agg(F.count("*").alias("n"))


def token_counts(spark, folder):
    return N.token_counts(_tokens(spark, folder))


def token_class_ratio(spark, folder):
    return N.class_shares(N.token_counts(_tokens(spark, folder)))


def class_prior(spark, folder):
    counts = N.token_counts(_tokens(spark, folder))
    return N.class_priors(counts).withColumn("among", F.lit("all")).unionByName(N.class_priors(counts, 1.0, "transition").withColumn("among", F.lit("transition")))


def _lengths(spark, folder):
    return _tokens(spark, folder).groupBy("id").agg(F.count("*").cast("int").alias("length"))


#: Tokens of a training row, of its system prompt, and of its end mark.
ROW, SYSTEM, END = 256, 12, 1


def _slices(spark, folder):
    return N.slices(_lengths(spark, folder), "id", ROW, SYSTEM, END)


def slice_windows(spark, folder):
    return _slices(spark, folder)


def pack_next_fit(spark, folder):
    """Slices in batches of 2,000 of the seeded order, packed into rows."""
    ranked = S.hash_ranked(_slices(spark, folder).withColumn("key", F.concat_ws(":", "id", "start")), "key")
    return N.pack_next_fit(ranked.select(F.floor(F.col("rank") / 2000).alias("batch"), F.pmod("rank", F.lit(2000)).cast("long").alias("place"), F.col("size").cast("long").alias("size")), ROW)


def dataset_stats(spark, folder):
    return N.packing_stats(_lengths(spark, folder), pack_next_fit(spark, folder), ROW)


def vocabulary_prior(spark, folder):
    """The adjustment of every token of the vocabulary."""
    return N.vocabulary_priors(N.token_counts(_tokens(spark, folder)))


def mask_vocabulary(spark, folder):
    """Masks and ids of control tokens, an id being a token's place in the seeded order of the vocabulary: control tokens and all counted ones."""
    control = spark.createDataFrame([(t,) for t in TRANSITIONS], "token string")
    every = N.token_counts(_tokens(spark, folder)).select("token").unionByName(control).distinct()
    return N.mask_vocabulary(S.hash_ranked(every, "token").select("token", F.col("rank").cast("long").alias("id")))


def tail_budget(spark, folder):
    """The newest turns of each chat within 120 words."""
    t = chat.turns(spark, folder).select("id", "turn", n_words(F.col("value")).alias("n"))
    return N.tail_budget(t, "id", "turn", "n", 120)


def _logits(spark, folder):
    """Embeddings as logits over 64 classes, the first five of which are control tokens."""
    e = table(spark, folder, "embeddings")
    weights = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(t).alias("t")) for _, r, t in WEIGHTS])
    w = F.element_at(weights, (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.col("label").cast("int").alias("label"), F.when(F.col("label") < 5, F.col("label") + 2).otherwise(F.lit(1)).cast("int").alias("mask"), w["r"].alias("resp_w"), w["t"].alias("trans_w"))


def _adjustments():
    """Log priors of the five control classes 0.02, 0.04, ..., none for the others."""
    return F.array(*[F.lit(0.02 * (k + 1)) if k < 5 else F.lit(1.0) for k in range(64)])


def _losses(spark, folder):
    e = _logits(spark, folder)
    adj = F.transform(_adjustments(), F.ln)
    return e.select("vec_id", "mask", "resp_w", "trans_w", N.cross_entropy(F.col("logits"), F.col("label")).alias("loss"), N.cross_entropy(N.adjusted(F.col("logits"), adj), F.col("label")).alias("adj_loss"), N.fuzzy(F.col("logits"), [0, 1, 2, 3, 4]).alias("fuzzy_loss"))


def row_losses(spark, folder):
    return _losses(spark, folder).select("vec_id", "mask", *[F.round(c, 6).alias(c) for c in ("loss", "adj_loss", "fuzzy_loss")])


def balanced_loss(spark, folder):
    return N.balanced_loss(_losses(spark, folder))


def token_loss(spark, folder):
    return N.token_loss(_losses(spark, folder))


def logit_adjusted_loss(spark, folder):
    return N.token_loss(_losses(spark, folder), "loss", "adj_loss")


def all_adjusted_loss(spark, folder):
    return N.all_adjusted_loss(_losses(spark, folder).withColumn("loss", F.col("adj_loss")))


def fuzzy_loss(spark, folder):
    return N.token_loss(_losses(spark, folder), "fuzzy_loss", "adj_loss")


def fuzzy_exact_loss(spark, folder):
    """Responses by the fuzzy loss, but for a quarter of them drawn by hash, which have the exact one."""
    rows = _losses(spark, folder).withColumn("mixed", N.fuzzy_or_exact(N.drawn(F.col("vec_id"), 4), F.col("loss"), F.col("fuzzy_loss")))
    return N.token_loss(rows, "mixed", "adj_loss")


def masked_softmax(spark, folder):
    """The likeliest class and its probability with the control classes 2 to 4 forbidden."""
    p = N.softmax_masked(F.col("logits"), [2, 3, 4])
    return _logits(spark, folder).select("vec_id", N.argmax(p).alias("best"), F.round(F.array_max(p), 6).alias("p"))


QUERIES = {
    f.__name__: f
    for f in (
        token_masks, token_counts, token_class_ratio, class_prior, dataset_stats, slice_windows, pack_next_fit, tail_budget, row_losses, balanced_loss, token_loss,
        logit_adjusted_loss, all_adjusted_loss, fuzzy_loss, fuzzy_exact_loss, masked_softmax, vocabulary_prior, mask_vocabulary,
    )
}

TOKENS = tape.ENTRIES + r""", tk AS (SELECT id, pos, CASE WHEN starts_with(token, '<interlocutor>') THEN 0 WHEN token = '[C.LISTEN]' THEN 2 WHEN token = '[C.SPEAK]' THEN 3 WHEN token = '[S.LISTEN.INTERRUPT]' THEN 4
    WHEN token = '[S.LISTEN.NATURAL]' THEN 5 WHEN token = '[S.SPEAK]' THEN 6 ELSE 1 END AS mask,
    unnest(list_filter(string_split_regex(CASE WHEN starts_with(token, '<interlocutor>') THEN '<user> ' || substr(token, 15) ELSE token END, '\s+'), lambda w: w <> '')) AS token FROM en)"""
_COUNTS = TOKENS + """, cn AS (SELECT token, count(*) AS n FROM tk WHERE mask >= 1 GROUP BY token),
    cl AS (SELECT CASE WHEN token IN ('[C.LISTEN]', '[C.SPEAK]', '[S.LISTEN.INTERRUPT]', '[S.LISTEN.NATURAL]', '[S.SPEAK]') THEN token ELSE 'response' END AS token, CAST(sum(n) AS BIGINT) AS n FROM cn GROUP BY 1)"""
_LEN = TOKENS + ", ln AS (SELECT id, CAST(count(*) AS INTEGER) AS length FROM tk GROUP BY id)"
_SLICES = _LEN + ", ss AS (SELECT id, length, CAST(unnest(range(0, length, 212)) AS INTEGER) AS start FROM ln WHERE length > 0), sl AS (SELECT id, start, CAST(least(243, length - start) + 13 AS INTEGER) AS size FROM ss)"
_PACKED = _SLICES.replace("WITH ", "WITH RECURSIVE ", 1) + """, rk AS (SELECT CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY md5(id || ':' || start || '|42'), id || ':' || start) - 1 AS rank FROM sl),
    it AS (SELECT rank // 2000 AS batch, rank % 2000 AS place, size FROM rk),
    pk AS (SELECT batch, place, size, CAST(0 AS BIGINT) AS box, size AS fill FROM it WHERE place = 0
      UNION ALL SELECT i.batch, i.place, i.size, p.box + CASE WHEN p.fill + i.size > 256 THEN 1 ELSE 0 END, CASE WHEN p.fill + i.size > 256 THEN i.size ELSE p.fill + i.size END FROM pk p JOIN it i ON i.batch = p.batch AND i.place = p.place + 1)"""
_LOSS = """WITH e AS (SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(CASE WHEN label < 5 THEN label + 2 ELSE 1 END AS INTEGER) AS mask, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS lg,
    CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 2.0 END AS resp_w, CASE vec_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END AS trans_w FROM embeddings),
  a AS (SELECT *, list_transform(lg, lambda x, i: x + CASE WHEN i <= 5 THEN ln(0.02 * i) ELSE 0.0 END) AS ag, list_slice(lg, 6, 64) AS rg FROM e),
  l AS (SELECT *, list_max(lg) + ln(list_sum(list_transform(lg, lambda x: exp(x - list_max(lg))))) AS z, list_max(ag) + ln(list_sum(list_transform(ag, lambda x: exp(x - list_max(ag))))) AS az,
    list_max(rg) + ln(list_sum(list_transform(rg, lambda x: exp(x - list_max(rg))))) AS rz FROM a),
  ls AS (SELECT vec_id, mask, CAST(resp_w AS DOUBLE) AS resp_w, CAST(trans_w AS DOUBLE) AS trans_w, z - lg[label + 1] AS loss, az - ag[label + 1] AS adj_loss, z - rz AS fuzzy_loss,
    CASE WHEN mask = 1 THEN CAST(resp_w AS DOUBLE) ELSE CAST(trans_w AS DOUBLE) END AS w FROM l)"""


def _mean_sql(resp: str, trans: str) -> str:
    return _LOSS + f""", t AS (SELECT greatest(sum(w), 1e-9) AS w, sum(CASE WHEN mask = 1 THEN {resp} * w ELSE 0 END) AS r, sum(CASE WHEN mask >= 2 THEN {trans} * w ELSE 0 END) AS t FROM ls WHERE mask >= 1)
      SELECT round(r / w, 6) AS response, round(t / w, 6) AS transition, round(r / w + t / w, 6) AS total FROM t"""


SQL = {
    "token_masks": TOKENS + " SELECT id, mask, count(*) AS n FROM tk GROUP BY id, mask",
    "token_counts": _COUNTS + " SELECT * FROM cn",
    "token_class_ratio": _COUNTS + " SELECT token, n, round(n / sum(n) OVER (), 9) AS share FROM cl",
    "class_prior": _COUNTS + """ SELECT token, round(ln(greatest(n / sum(n) OVER (), 1e-9)), 6) AS adjustment, 'all' AS among FROM cl UNION ALL
      SELECT token, round(ln(greatest(n / CASE WHEN token = 'response' THEN sum(n) OVER () ELSE sum(n) FILTER (WHERE token <> 'response') OVER () END, 1e-9)), 6), 'transition' FROM cl""",
    "dataset_stats": _PACKED + """, b AS (SELECT sum(n) AS n FROM (SELECT max(box) + 1 AS n FROM pk GROUP BY batch))
      SELECT count(*) AS n, CAST(sum(length) AS BIGINT) AS total, round(avg(length), 9) AS mean, max(length) AS longest, min(length) AS shortest,
        CAST((SELECT n FROM b) AS BIGINT) AS n_packed, round(sum(length) / ((SELECT n FROM b) * 256), 9) AS efficiency FROM ln""",
    "slice_windows": _SLICES + " SELECT id, start, size FROM sl",
    "pack_next_fit": _PACKED + " SELECT batch, place, size, box FROM pk",
    "vocabulary_prior": _COUNTS + """, pr AS (SELECT token AS class, round(ln(greatest(n / sum(n) OVER (), 1e-9)), 6) AS adjustment FROM cl)
      SELECT cn.token, adjustment FROM cn JOIN pr ON class = CASE WHEN token IN ('[C.LISTEN]', '[C.SPEAK]', '[S.LISTEN.INTERRUPT]', '[S.LISTEN.NATURAL]', '[S.SPEAK]') THEN token ELSE 'response' END""",
    "mask_vocabulary": _COUNTS + """, v AS (SELECT token, row_number() OVER (ORDER BY md5(token || '|42'), token) - 1 AS id FROM (SELECT token FROM cn UNION SELECT unnest(['[C.LISTEN]', '[C.SPEAK]', '[S.LISTEN.INTERRUPT]', '[S.LISTEN.NATURAL]', '[S.SPEAK]'])))
      SELECT token, CAST(CASE token WHEN '[C.LISTEN]' THEN 2 WHEN '[C.SPEAK]' THEN 3 WHEN '[S.LISTEN.INTERRUPT]' THEN 4 WHEN '[S.LISTEN.NATURAL]' THEN 5 ELSE 6 END AS INTEGER) AS mask, id FROM v
      WHERE token IN ('[C.LISTEN]', '[C.SPEAK]', '[S.LISTEN.INTERRUPT]', '[S.LISTEN.NATURAL]', '[S.SPEAK]')""",
    "fuzzy_exact_loss": _mean_sql("CASE WHEN md5(CAST(vec_id AS VARCHAR) || '|7') < '4' THEN loss ELSE fuzzy_loss END", "adj_loss"),
    "tail_budget": chat.TURNS + r""", n AS (SELECT id, turn, CAST(len(list_filter(string_split_regex(value, '\s+'), lambda w: w <> '')) AS INTEGER) AS n FROM turns),
      s AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY id ORDER BY turn DESC) AS r FROM n)
      SELECT id, turn, n FROM s WHERE c <= 120 OR r = 1""",
    "row_losses": _LOSS + " SELECT vec_id, mask, round(loss, 6) AS loss, round(adj_loss, 6) AS adj_loss, round(fuzzy_loss, 6) AS fuzzy_loss FROM ls",
    "balanced_loss": _LOSS + """, m AS (SELECT mask, sum(loss * w) / greatest(sum(w), 1e-9) AS m FROM ls WHERE mask >= 1 GROUP BY mask),
      t AS (SELECT coalesce(avg(m) FILTER (WHERE mask = 1), 0) AS r, coalesce(avg(m) FILTER (WHERE mask >= 2), 0) AS t FROM m)
      SELECT round(r, 6) AS response, round(t, 6) AS transition, round(r + t, 6) AS total FROM t""",
    "token_loss": _mean_sql("loss", "loss"),
    "logit_adjusted_loss": _mean_sql("loss", "adj_loss"),
    "fuzzy_loss": _mean_sql("fuzzy_loss", "adj_loss"),
    "all_adjusted_loss": _LOSS + """, t AS (SELECT coalesce(avg(adj_loss * resp_w) FILTER (WHERE mask = 1), 0) AS r, coalesce(avg(adj_loss * trans_w) FILTER (WHERE mask >= 2), 0) AS t FROM ls)
      SELECT round(r, 6) AS response, round(t, 6) AS transition, round(r + t, 6) AS total FROM t""",
    "masked_softmax": _LOSS + """, b AS (SELECT vec_id, list_transform(lg, lambda x, i: CASE WHEN i IN (3, 4, 5) THEN x - 100 ELSE x END) AS g FROM e)
      SELECT vec_id, CAST(list_position(g, list_max(g)) - 1 AS INTEGER) AS best, round(1 / list_sum(list_transform(g, lambda x: exp(x - list_max(g)))), 6) AS p FROM b""",
}

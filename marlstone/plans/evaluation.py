"""Evaluation metrics over paired texts and chains."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import metrics as M
from marlstone.plans.base import table

c = F.col


def _pairs(spark, sf):
    """A user turn as prediction, the assistant turn after it as truth; some words are put in for the term metrics."""
    t = table(spark, sf, "conversations")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    p = t.withColumn("gt", nxt).where("gt is not null")
    terms = F.array(*map(F.lit, (" no sign of carcinoma 3 mm", " carcinoma invasive 3mm, 12.5 %", " necrosis absent; carcinoma-free 7 cm", " polyp")))
    k = (c("conv_id") + c("turn")) % 4
    return p.select(c("conv_id").alias("case"), c("turn").alias("pos"), F.concat("text", F.get(terms, k.cast("int"))).alias("pred"), F.concat("gt", F.get(terms, ((k + c("turn")) % 4).cast("int"))).alias("gt"))


def _chains(spark, sf):
    """Ordered (key, answer) of each user, predicted and true, from events."""
    e = table(spark, sf, "events")
    item = lambda a: F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.struct(c("event_type").alias("key"), a.alias("answer")).alias("s")))), lambda x: x["s"])
    a = F.concat(F.lit("Value "), (c("event_id") % 4).cast("string"))
    b = F.concat(F.lit("value. "), F.when(c("event_id") % 5 == 0, (c("event_id") % 3).cast("string")).otherwise((c("event_id") % 4).cast("string")))
    return e.groupBy((c("user_id") * 100 + F.floor(c("event_id") / 2500)).alias("case")).agg(item(a).alias("pred"), item(b).alias("gt"))


def token_f1(spark, sf):
    return _pairs(spark, sf).select("case", "pos", F.round(M.token_f1(c("pred"), c("gt")), 6).alias("f1"))


def answer_recall(spark, sf):
    return _pairs(spark, sf).select("case", "pos", F.round(M.answer_recall(c("pred"), c("gt")), 6).alias("recall"))


def negation_consistency(spark, sf):
    return _pairs(spark, sf).select("case", "pos", M.negation_consistency(c("pred"), c("gt")).alias("m")).select("case", "pos", F.round("m.score", 6).alias("score"), "m.n")


def weighted_negation_mean(spark, sf):
    n = negation_consistency(spark, sf)
    return n.agg(F.round(F.try_divide(F.sum(c("score") * c("n")), F.sum("n")), 6).alias("mean"), F.sum("n").alias("n"))


def numeric_fidelity(spark, sf):
    return _pairs(spark, sf).select("case", "pos", F.round(M.numeric_fidelity(c("pred"), c("gt")), 6).alias("fidelity"))


def bleu4(spark, sf):
    return _pairs(spark, sf).select("case", "pos", F.round(M.bleu4(c("pred"), c("gt")), 6).alias("bleu"))


def rouge_l(spark, sf):
    return M.rouge_l(_pairs(spark, sf), "pred", "gt").select("case", "pos", "rouge_l")


def edge_f1(spark, sf):
    return _chains(spark, sf).select("case", F.round(M.edge_f1(c("pred"), c("gt")), 6).alias("f1"))


def path_validity(spark, sf):
    none = F.array().cast("array<string>")
    path = F.when(c("case") % 2 == 0, F.transform("gt", lambda s: s["key"])).otherwise(none)
    return _chains(spark, sf).select("case", M.path_valid(path, path, c("pred"), c("gt")).alias("valid"))


def node_accuracy(spark, sf):
    return _chains(spark, sf).select("case", F.round(M.node_accuracy(c("pred"), F.transform("gt", lambda s: F.struct(s["key"].alias("key"), F.replace(s["answer"], F.lit(".")).alias("answer")))), 6).alias("accuracy"))


def baseline_report(spark, sf):
    p = _pairs(spark, sf).select((c("case") % 3).alias("baseline"), M.token_f1(c("pred"), c("gt")).alias("f1"), M.answer_recall(c("pred"), c("gt")).alias("recall"), M.numeric_fidelity(c("pred"), c("gt")).alias("num"))
    return p.groupBy("baseline").agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("num"), 6).alias("num"), F.count(F.lit(1)).alias("n"))


def corpus_bag_overlap(spark, sf):
    p = _pairs(spark, sf)
    return p.select("case", "pos", M.bag_overlap(T.tokens(c("pred")), T.tokens(c("gt"))).alias("overlap"))


_P = r"""p0 AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
 p1 AS (SELECT conv_id AS "case", turn AS pos, text || [' no sign of carcinoma 3 mm', ' carcinoma invasive 3mm, 12.5 %', ' necrosis absent; carcinoma-free 7 cm', ' polyp'][(conv_id + turn) % 4 + 1] AS pred,
 g || [' no sign of carcinoma 3 mm', ' carcinoma invasive 3mm, 12.5 %', ' necrosis absent; carcinoma-free 7 cm', ' polyp'][((conv_id + turn) % 4 + turn) % 4 + 1] AS gt FROM p0 WHERE g IS NOT NULL)"""


def _norm(col):
    one = f"regexp_replace(regexp_replace(trim(lower({col})), '(\\p{{L}})[^\\p{{L}}\\p{{N}}_\\s](\\p{{L}})', '\\1 \\2', 'g'), '(\\p{{L}})[^\\p{{L}}\\p{{N}}_\\s](\\p{{L}})', '\\1 \\2', 'g')"
    chars = f"string_split({one}, '')"
    kept = f"array_to_string(list_transform(range(1, len({chars}) + 1), lambda i: CASE WHEN regexp_matches({chars}[i], '[^\\p{{L}}\\p{{N}}_\\s]') AND NOT regexp_matches(coalesce({chars}[i - 1], ''), '\\p{{Nd}}') AND NOT regexp_matches(coalesce({chars}[i + 1], ''), '\\p{{Nd}}') THEN '' ELSE {chars}[i] END), '')"
    return f"list_filter(string_split(trim(regexp_replace({kept}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


_PW = f'{_P}, p AS (SELECT "case", pos, pred, gt, {_norm("pred")} AS pw, {_norm("gt")} AS gw FROM p1)'
_SETS = "len(list_intersect(pw, gw)) AS tp, len(list_distinct(pw)) AS np, len(list_distinct(gw)) AS ng"
_F1 = "CASE WHEN np = 0 OR ng = 0 OR tp = 0 THEN 0.0 ELSE 2.0 * tp / (np + ng) END"
_NUM = "list_transform(regexp_extract_all({0}, '(?i)\\d+\\.?\\d*\\s*(?:mm|cm|µm|mcm|%)?'), lambda x: lower(replace(x, ' ', '')))"
_BAG = "list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x)))))"
_N = f'n AS (SELECT "case", pos, {_NUM.format("gt")} AS gn, {_NUM.format("pred")} AS pn FROM p1), nf AS (SELECT "case", pos, CASE WHEN len(gn) = 0 THEN 1.0 ELSE coalesce({_BAG.format("gn", "pn")}, 0) / len(gn) END AS fid FROM n)'
_KW = ", ".join(f"'{k}'" for k in M.KEYWORDS)
_NEG = ", ".join(f"'{k}'" for k in M.NEGATIONS)


def _neg(w):
    return f"(len(list_filter(range(1, len({w}) + 1), lambda i: starts_with({w}[i], kw) AND len(list_intersect({w}[greatest(i - 4, 1):i - 1], [{_NEG}])) > 0)) > 0 OR len(list_filter({w}, lambda x: starts_with(x, kw) AND x LIKE '%free' AND x <> 'free')) > 0)"


_NEGQ = f'{_PW}, k AS (SELECT "case", pos, pw, gw, unnest([{_KW}]) AS kw FROM p), j AS (SELECT "case", pos, len(list_filter(pw, lambda x: starts_with(x, kw))) > 0 AND len(list_filter(gw, lambda x: starts_with(x, kw))) > 0 AS b2, {_neg("pw")} = {_neg("gw")} AS same FROM k), m AS (SELECT "case", pos, round(CASE WHEN count(*) FILTER (b2) = 0 THEN 1.0 ELSE count(*) FILTER (b2 AND same) / count(*) FILTER (b2) END, 6) AS score, CAST(count(*) FILTER (b2) AS INT) AS n FROM j GROUP BY ALL)'
_CH = "e AS (SELECT user_id * 100 + event_id // 2500 AS \"case\", event_id, event_type AS key, 'value ' || (event_id % 4) AS a, 'value ' || CASE WHEN event_id % 5 = 0 THEN event_id % 3 ELSE event_id % 4 END AS b FROM events)"
ORACLES = {
    "token_f1": f'WITH {_PW}, s AS (SELECT "case", pos, {_SETS} FROM p) SELECT "case", pos, round({_F1}, 6) AS f1 FROM s',
    "answer_recall": f'WITH {_PW}, s AS (SELECT "case", pos, {_SETS} FROM p) SELECT "case", pos, round(CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END, 6) AS recall FROM s',
    "negation_consistency": f'WITH {_NEGQ} SELECT "case", pos, score, n FROM m',
    "weighted_negation_mean": f"WITH {_NEGQ} SELECT round(sum(score * n) / nullif(sum(n), 0), 6) AS mean, sum(n)::BIGINT AS n FROM m",
    "numeric_fidelity": f'WITH {_P}, {_N} SELECT "case", pos, round(fid, 6) AS fidelity FROM nf',
    "edge_f1": f'WITH {_CH}, p AS (SELECT "case", list_distinct(list(key || chr(31) || a)) AS p, list_distinct(list(key || chr(31) || b)) AS g FROM e GROUP BY 1) SELECT "case", round(CASE WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, g)) / (len(p) + len(g)) END, 6) AS f1 FROM p',
    "path_validity": f'WITH {_CH} SELECT "case", CASE WHEN "case" % 2 = 0 THEN true ELSE bool_and(a = b) END AS valid FROM e GROUP BY 1',
    "node_accuracy": f'WITH {_CH}, l AS (SELECT "case", key, arg_max(a, event_id) AS a, arg_max(b, event_id) AS b FROM e GROUP BY 1, 2) SELECT "case", round(count(*) FILTER (a = b) / count(*), 6) AS accuracy FROM l GROUP BY 1',
    "baseline_report": f'WITH {_PW}, {_N}, s AS (SELECT "case", pos, {_SETS} FROM p) SELECT s."case" % 3 AS baseline, round(avg({_F1}), 6) AS f1, round(avg(CASE WHEN ng = 0 THEN 0.0 ELSE tp / ng END), 6) AS recall, round(avg(fid), 6) AS num, count(*) AS n FROM s JOIN nf ON s."case" = nf."case" AND s.pos = nf.pos GROUP BY 1',
    "corpus_bag_overlap": f"WITH {_P}, t AS (SELECT \"case\", pos, regexp_extract_all(lower(pred), '[\\p{{L}}\\p{{N}}_]+') AS a, regexp_extract_all(lower(gt), '[\\p{{L}}\\p{{N}}_]+') AS b FROM p1) SELECT \"case\", pos, CAST(coalesce({_BAG.format('a', 'b')}, 0) AS INT) AS overlap FROM t",
}
QUERIES = {n: globals()[n] for n in [*ORACLES, "bleu4", "rouge_l"]}

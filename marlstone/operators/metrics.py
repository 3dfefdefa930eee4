"""Chain and report metrics as row expressions over paired texts or chains."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: Negation words and the prefixes of terms that are compared for negation.
NEGATIONS = ("no", "not", "without", "absent", "negative", "none")
KEYWORDS = ("malignan", "carcinoma", "adenocarcinoma", "atyp", "dysplas", "hyperplas", "necro", "invas", "metasta", "mitos", "mitotic", "instability", "polyp", "adenomyosis", "endometriosis", "leiomyoma", "leiomyosarcoma", "inflammation", "inflammatory")
WINDOW = 4
NUMBER = r"(?i)\d+\.?\d*\s*(?:mm|cm|µm|mcm|%)?"


def f1_sets(p: Column, g: Column, both_empty: float) -> Column:
    """F1 of two arrays as sets; one empty side gives 0."""
    a, b = F.array_distinct(p), F.array_distinct(g)
    tp, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), both_empty).when((n == 0) | (m == 0) | (tp == 0), 0.0).otherwise(2.0 * tp / (n + m))


def token_f1(pred: Column, gt: Column) -> Column:
    return f1_sets(T.norm_tokens(pred), T.norm_tokens(gt), 0.0)


def answer_recall(pred: Column, gt: Column) -> Column:
    p, g = F.array_distinct(T.norm_tokens(pred)), F.array_distinct(T.norm_tokens(gt))
    return F.when(F.size(g) == 0, 0.0).otherwise(F.size(F.array_intersect(p, g)) / F.size(g))


def negation(words: Column, prefix: Column) -> Column:
    """A negation in the four words before a word of the prefix, or such a word that ends with free."""
    near = F.exists(F.transform(words, lambda w, i: F.when(w.startswith(prefix), F.exists(F.slice(words, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW))), lambda x: x.isin(*NEGATIONS))).otherwise(F.lit(False))), lambda b: b)
    return near | F.exists(words, lambda w: w.startswith(prefix) & w.endswith("free") & (w != "free"))


def negation_consistency(pred: Column, gt: Column) -> Column:
    """Struct (score, n): agreement over the prefixes that both texts have; (1, 0) if there are none."""
    def judge(words: Column) -> Column:
        p, g = words["p"], words["g"]
        both = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.exists(p, lambda w: w.startswith(k)) & F.exists(g, lambda w: w.startswith(k)))
        agree = F.filter(both, lambda k: negation(p, k) == negation(g, k))
        return F.struct(F.when(F.size(both) == 0, 1.0).otherwise(F.size(agree) / F.size(both)).alias("score"), F.size(both).alias("n"))

    return F.get(F.transform(F.array(F.struct(T.norm_tokens(pred).alias("p"), T.norm_tokens(gt).alias("g"))), judge), 0)


def numbers(t: Column) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda x: F.lower(F.replace(x, F.lit(" "))))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as bags: both are sorted together and counted run by run."""
    side = lambda arr, k: F.transform(arr, lambda x: F.struct(x.alias("x"), F.lit(k).alias("k")))
    both = F.array_sort(F.concat(side(a, 0), side(b, 1)))
    none = F.lit(0)

    def step(s: Column, e: Column) -> Column:
        same = s["x"] == e["x"]
        add = lambda n, k: F.when(same, s[n]).otherwise(none) + F.when(e["k"] == k, 1).otherwise(0)
        return F.struct(e["x"].alias("x"), add("a", 0).alias("a"), add("b", 1).alias("b"), (s["total"] + F.when(same, none).otherwise(F.least(s["a"], s["b"]))).alias("total"))

    start = F.struct(F.lit("").alias("x"), none.alias("a"), none.alias("b"), none.alias("total"))
    return F.aggregate(both, start, step, lambda s: s["total"] + F.least(s["a"], s["b"]))


def numeric_fidelity(pred: Column, gt: Column) -> Column:
    g = numbers(gt)
    return F.when(F.size(g) == 0, 1.0).otherwise(bag_overlap(g, numbers(pred)) / F.size(g))


def edge_f1(pred: Column, gt: Column) -> Column:
    """Of arrays of struct (key, answer), answers normalized."""
    norm = lambda c: F.transform(c, lambda s: F.concat_ws("\x1f", s["key"], T.metric_normalize(s["answer"])))
    return f1_sets(norm(pred), norm(gt), 1.0)


def path_valid(pred_path: Column, gt_path: Column, pred: Column, gt: Column) -> Column:
    """Node paths where both have one, else the ordered (key, answer) lists."""
    norm = lambda c: F.transform(c, lambda s: F.concat_ws("\x1f", s["key"], T.metric_normalize(s["answer"])))
    return F.when((F.size(pred_path) > 0) & (F.size(gt_path) > 0), pred_path == gt_path).otherwise(norm(pred) == norm(gt))


def node_accuracy(pred: Column, gt: Column) -> Column:
    """Share of all true nodes whose answer is the predicted one, trimmed and lower-cased; of equal keys the last counts."""
    last = lambda c, k: F.get(F.reverse(F.filter(c, lambda s: s["key"] == k)), 0)["answer"]
    norm = lambda a: F.lower(F.trim(a))
    keys = F.array_distinct(F.transform(gt, lambda s: s["key"]))
    hit = F.filter(keys, lambda k: F.coalesce(norm(last(pred, k)) == norm(last(gt, k)), F.lit(False)))
    return F.when(F.size(keys) == 0, 0.0).otherwise(F.size(hit) / F.size(keys))


def grams(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def bleu4(pred: Column, gt: Column) -> Column:
    """Sentence BLEU-4 with add-one smoothing above unigrams; 0 without a common word."""
    def judge(words: Column) -> Column:
        p, g = words["p"], words["g"]
        logs = F.lit(0.0)
        for n in range(1, 5):
            hit, all_ = bag_overlap(grams(p, n), grams(g, n)), F.size(grams(p, n))
            one = 0 if n == 1 else 1
            logs = logs + F.log(F.when(hit + one > 0, (hit + one) / (all_ + one)).otherwise(F.lit(1e-9))) / 4
        brief = F.when(F.size(p) >= F.size(g), 0.0).otherwise(1 - F.size(g) / F.greatest(F.size(p), F.lit(1)))
        return F.when((F.size(p) == 0) | (F.size(F.array_intersect(p, g)) == 0), 0.0).otherwise(F.exp(logs + brief))

    return F.get(F.transform(F.array(F.struct(T.norm_tokens(pred).alias("p"), T.norm_tokens(gt).alias("g"))), judge), 0)


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, a row of the table at a time in numpy."""
    if not len(a) or not len(b):
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[w] for w in a]), np.array([codes[w] for w in b])
    row = np.zeros(len(y) + 1, np.int64)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return int(row[-1])


def rouge_l(df: DataFrame, pred: str, gt: str, out: str = "rouge_l") -> DataFrame:
    """F of the longest common subsequence of normalized words (not stemmed), in Arrow batches."""
    @F.pandas_udf("double")
    def score(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([2.0 * lcs_length(a, b) / (len(a) + len(b)) if len(a) and len(b) else 0.0 for a, b in zip(p, g, strict=True)])

    return df.withColumn(out, F.round(score(T.norm_tokens(F.col(pred)), T.norm_tokens(F.col(gt))), 6))


def accuracy_cuts(rows: DataFrame, *by: str) -> DataFrame:
    """Correct, total and accuracy overall and for each column of ``by``, in one pass of grouping sets."""
    rows.createOrReplaceTempView("_accuracy_rows")
    sets = ", ".join(["()"] + [f"({b})" for b in by])
    return rows.sparkSession.sql(f"SELECT {', '.join(by)}, count_if(correct) AS n_correct, count(*) AS n, round(avg(int(correct)), 6) AS accuracy FROM _accuracy_rows GROUP BY GROUPING SETS ({sets})")

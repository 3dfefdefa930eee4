"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once a document and keeps the measurements and one bit a failed rule; ``apply_policy``
reads a versioned policy (a mask and a tolerance) against the stored bits, so a new policy never touches a text again;
``ablation`` counts, by bitwise aggregation over the distinct masks, what each rule rejects and what it alone rejects.

Texts are shuffled once, evenly; ``ablation`` groups by the distinct masks (at most 2**rules) with partial sums.

Defined results: null, empty or blank text has no words, all measures 0 and fails ``few_words``; a text with fewer than
three words has no window; repeated rows and ties are judged alike; extra columns are kept, and measures replace
input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base rules' bounds and the characters that count as symbols.
MIN_WORDS, MAX_REPEAT_PCT, SYMBOLS = 50, 50, "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capital_words", "n_chars_all", "n_long_words")


def _rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("few_words", c("n_words") < MIN_WORDS),
        ("repeated_windows", 100 * c("n_repeat_words") > MAX_REPEAT_PCT * c("n_words")),
        ("symbols", 100 * c("n_symbols") > 30 * c("n_words")),
        ("dup_lines", (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 50 * c("n_lines"))),
        ("word_length_low", c("word_chars") < 2 * c("n_words")),
        ("word_length_high", c("word_chars") > 20 * c("n_words")),
        ("few_letters", 100 * c("n_letter_words") < 60 * c("n_words")),
        ("shouting", 100 * c("n_capital_words") > 60 * c("n_words")),
        ("unbroken", 100 * c("n_long_words") > 20 * c("n_words")),
    ]


RULES = ("few_words", "repeated_windows", "symbols", "dup_lines", "word_length_low", "word_length_high", "few_letters", "shouting", "unbroken")
BASE_MASK = 0b11


def mask_of(*names: str) -> int:
    return sum(1 << RULES.index(n) for n in names)


#: Versioned policies: a text is kept if at most ``tolerance`` of the policy's rules fail and none of the hard ones.
POLICIES = {
    "base": {"hard": BASE_MASK, "soft": 0, "tolerance": 0},
    "v1": {"hard": BASE_MASK | mask_of("symbols", "dup_lines", "word_length_low", "word_length_high", "few_letters", "shouting", "unbroken"), "soft": 0, "tolerance": 0},
    "lenient": {"hard": BASE_MASK, "soft": mask_of(*RULES[2:]), "tolerance": 1},
}


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """All measures and ``failed`` (a bit a rule) beside the columns of ``docs`` (or those in ``keep``).

    Rows are dealt once by a row number of their own, so a hot source or key is no hot task; every later step stays in
    that partitioning: words are exploded with the two words after them, windows of a row are counted by fingerprint
    (64 bits, compared within one text only), and a second ordered window marks the words they cover. What belongs to
    the row itself travels on its first word. Long texts only mean more rows, which sort and spill.
    """
    clash = [c for c in docs.columns if c in MEASURES or c == "failed"]
    docs = docs.drop(*clash)
    keep = [c for c in docs.columns if keep is None or c in keep]
    bare = F.col("_t")
    for ch in SYMBOLS:
        bare = F.replace(bare, F.lit(ch))
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct(*[c for c in keep if c != text]).alias("_row") if keep != [text] else F.struct(F.lit(0)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(text).isNull().alias("_none")).repartition("_rid")
    ln = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("_rid", "_row", "_t", "_none", ln.alias("_l"), F.split(F.trim(F.col("_t"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+").alias("_w"))
    own = F.struct(
        F.col("_row").alias("row"),
        *([F.when(~F.col("_none"), F.col("_t")).alias("text")] if text in keep else []),
        (F.length("_t") - F.length(bare)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.length("_t").cast("long").alias("n_chars_all"),
    )
    # only the first word carries what belongs to the row: a copy beside every word would grow with the square of a text
    after = lambda k: F.slice("_w", k, F.size("_w"))
    word = rows.select("_rid", F.posexplode(F.arrays_zip(F.col("_w").alias("a"), after(2).alias("b"), after(3).alias("c"), F.array(own).alias("own"))).alias("_pos", "_x"))
    w = F.col("_x.a")
    word = word.select(
        "_rid",
        "_pos",
        F.col("_x.own").alias("_own"),
        F.when(F.col("_x.c").isNotNull(), F.xxhash64("_x.a", "_x.b", "_x.c")).alias("_h"),
        F.length(w).alias("_len"),
        # an all-capitals word, and a word with a letter in it, as two bits
        (F.when((w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1), 1).otherwise(0) + F.when(w.rlike(r"\p{L}"), 2).otherwise(0)).alias("_kind"),
    )
    word = word.withColumn("_twice", F.col("_h").isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy("_rid", "_h")) > 1))
    order = Window.partitionBy("_rid").orderBy("_pos")
    word = word.withColumn("_in", F.col("_twice") | F.coalesce(F.lag("_twice", 1).over(order), F.lit(False)) | F.coalesce(F.lag("_twice", 2).over(order), F.lit(False)))
    # sums over the row, read off its first word: an aggregate would copy what the row carries once a word
    all_ = Window.partitionBy("_rid")
    total = lambda cond: F.sum(F.when(cond, 1).otherwise(0).cast("long")).over(all_)
    book = word.withColumns({
        "n_words": total(F.col("_len") > 0),
        "word_chars": F.sum(F.col("_len").cast("long")).over(all_),
        "n_repeat_words": total(F.col("_in")),
        "n_letter_words": total(F.col("_kind") >= 2),
        "n_capital_words": total(F.col("_kind").isin(1, 3)),
        "n_long_words": total(F.col("_len") > 40),
    }).where("_pos = 0")
    out = book.select(*[(F.col("_own.text") if c == text else F.col("_own.row")[c]).alias(c) for c in keep], *[F.col(f"_own.{m}").alias(m) if m in ("n_symbols", "n_lines", "n_dup_lines", "n_chars_all") else F.col(m) for m in MEASURES])
    bits = [F.when(cond, F.lit(1 << i)).otherwise(0) for i, (_, cond) in enumerate(_rules())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return out.withColumn("failed", mask)


def verdict(policy: str = "v1", failed: str = "failed") -> Column:
    p = POLICIES[policy]
    f = F.col(failed)
    return (f.bitwiseAND(F.lit(p["hard"])) == 0) & (F.bit_count(f.bitwiseAND(F.lit(p["soft"]))) <= p["tolerance"])


def apply_policy(book: DataFrame, policy: str = "v1") -> DataFrame:
    """``kept`` under a policy, from the stored bits alone."""
    return book.withColumn("kept", verdict(policy))


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """A row a rule: documents that fail it, that only it rejects, and that the policy would keep without it."""
    p = POLICIES[policy]
    by_mask = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    each = by_mask.withColumn("bit", F.explode(F.array(*[F.lit(i) for i in range(len(RULES))])))
    one = F.expr("shiftleft(1, bit)")
    f, left = F.col("failed"), F.col("failed").bitwiseAND(F.bitwise_not(one))
    ok = lambda x: (x.bitwiseAND(F.lit(p["hard"])) == 0) & (F.bit_count(x.bitwiseAND(F.lit(p["soft"]))) <= p["tolerance"])
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return each.groupBy("bit").agg(count(f.bitwiseAND(one) != 0)("n_fail"), count(f == one)("n_only"), count(~ok(f) & ok(left))("n_regained")).withColumn("rule", F.element_at(F.array(*map(F.lit, RULES)), F.col("bit") + 1)).select("rule", "n_fail", "n_only", "n_regained")

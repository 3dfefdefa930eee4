"""Text normalizers, parsers and answer resolution as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Markers that stand for no value, and words that never name an option by themselves.
NULL_LIKE = ("nan", "n.a.", "na", "none")
MODIFIERS = ("positive", "negative", "present", "moderate", "severe", "focal", "diffuse", "mild")
_PUNCT = r"[^\p{L}\p{N}_\s]"


def first_filled(*cols: Column) -> Column:
    """The first that is not null or empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def metric_normalize(t: Column) -> Column:
    """Lower-cased; punctuation between letters becomes a space, other punctuation goes unless it touches a digit."""
    s = F.trim(F.lower(t))
    s = F.regexp_replace(s, rf"(?<=\p{{L}}){_PUNCT}(?=\p{{L}})", " ")
    s = F.regexp_replace(s, rf"(?<!\p{{Nd}}){_PUNCT}(?!\p{{Nd}})", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def norm_tokens(t: Column) -> Column:
    return F.filter(F.split(metric_normalize(t), " "), lambda w: w != "")


def canonical_key(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(t)), r"[\s\-]+", "_"), "[^a-z0-9_]", "")


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0))


def strip(t: Column, chars: str = "`\"' \t\r\n.,;") -> Column:
    return F.trim(t, F.lit(chars))


def answer_text(raw: Column) -> Column:
    """What an answer says: a JSON field or string, what follows ``label:``, without quotes and stops."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    field = F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in ("answer", "choice", "label")])
    text = F.when(t.startswith('"') & t.endswith('"') & (F.length(t) > 1), F.get_json_object(F.concat(F.lit('{"a":'), t, F.lit("}")), "$.a"))
    label = F.regexp_extract(t, r"(?is)^(?:answer|choice|label)\s*:\s*(.+)$", 1)
    return F.coalesce(F.trim(field), F.trim(text), strip(F.when(label != "", F.trim(label)).otherwise(t)))


def _whole(key: Column, part: Column) -> Column:
    """``part`` in ``key`` between anything but letters and digits."""
    return (part != "") & F.regexp_like(key, F.concat(F.lit("(?<![a-z0-9])"), part, F.lit("(?![a-z0-9])")))


def resolve_answer(raw: Column, options: Column, edges: Column, interaction: Column) -> Column:
    """An option of the node, or null where the answer names none or several. ``edges`` are the answers with an edge."""
    text = answer_text(raw)
    free = F.nullif(F.trim(raw), F.lit(""))

    def one(t: Column) -> Column:
        key = canonical_key(t)
        same = F.filter(options, lambda o: canonical_key(o) == key)
        said = F.filter(options, lambda o: _whole(key, canonical_key(o)))
        return F.when(t == "", None).when(F.array_contains(edges, t), t).when(F.size(same) == 1, F.get(same, 0)).when(F.size(said) == 1, F.get(said, 0))

    def several(t: Column) -> Column:
        keys = F.filter(F.transform(F.split(t, r"(?i),|\band\b|\n"), canonical_key), lambda k: k != "")

        def named(k: Column) -> Column:
            same = F.filter(options, lambda o: canonical_key(o) == k)
            words = F.filter(F.split(k, "_"), lambda w: (F.length(w) >= 4) & ~w.isin(*MODIFIERS))
            said = F.filter(options, lambda o: F.exists(words, lambda w: _whole(canonical_key(o), w)))
            return F.when(F.size(same) == 1, same).otherwise(said)

        found = F.array_sort(F.array_distinct(F.flatten(F.transform(keys, named))))
        return F.when(F.size(found) > 0, F.array_join(found, ","))

    return F.when(interaction == "free_text", free).when(interaction == "multi_select", several(text)).when(F.size(options) == 1, F.get(options, 0)).otherwise(one(text))


def soft_json(t: Column, key: str) -> Column:
    """A field of a JSON object that may stand inside other text: from the first brace to the last."""
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.get_json_object(t, f"$.{key}"), F.get_json_object(inner, f"$.{key}"))


def unfence(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(t), r"(?s)^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def null_like(t: Column, to: str | None = None) -> Column:
    s = F.trim(t)
    return F.when(s.isNull() | (s == "") | F.lower(s).isin(*NULL_LIKE), F.lit(to)).otherwise(s)


def token_list(t: Column, separators: str = "[,;]", base_names: bool = True) -> Column:
    parts = F.filter(F.transform(F.split(t, separators), lambda s: F.trim(s)), lambda s: (s != "") & ~F.lower(s).isin(*NULL_LIKE))
    return F.array_distinct(F.transform(parts, lambda s: F.element_at(F.split(s, "/"), -1)) if base_names else parts)


def safe_name(t: Column) -> Column:
    return F.regexp_replace(t, "[^A-Za-z0-9._-]+", "_")


def label_parse(t: Column, labels: tuple[str, ...], default: str = "insufficient_or_uncertain") -> Column:
    field = F.trim(F.get_json_object(t, "$.classification"))
    first = reduce(lambda a, x: a.when(F.regexp_like(t, F.lit(rf"\b{x}\b")), x), labels[1:], F.when(F.regexp_like(t, F.lit(rf"\b{labels[0]}\b")), labels[0]))
    return F.coalesce(F.when(field.isin(*labels), field), first, F.lit(default))


def qa_pairs(t: Column) -> Column:
    """Steps (node_id, question, answer) of Q/A lines; the whole text as one step if there are none; FINAL: last."""
    lines = F.filter(F.transform(F.split(t, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    after = lambda s: F.trim(F.regexp_replace(s, r"^[^:]*:", ""))
    none = F.array().cast("array<struct<q:string,a:string>>")
    start = F.struct(F.lit("").alias("q"), none.alias("qa"), F.lit("").alias("final"))

    def step(s: Column, ln: Column) -> Column:
        up, colon = F.upper(ln), ln.contains(":")
        return (
            F.when(up.startswith("FINAL:"), F.struct(s["q"].alias("q"), s["qa"].alias("qa"), after(ln).alias("final")))
            .when(up.startswith("Q") & colon, F.struct(after(ln).alias("q"), s["qa"].alias("qa"), s["final"].alias("final")))
            .when(up.startswith("A") & colon & (s["q"] != ""), F.struct(F.lit("").alias("q"), F.array_append(s["qa"], F.struct(s["q"].alias("q"), after(ln).alias("a"))).alias("qa"), s["final"].alias("final")))
            .otherwise(s)
        )

    got = F.aggregate(lines, start, step)
    item = lambda n, q, a: F.struct(n.alias("node_id"), q.alias("question"), a.alias("answer"))
    some = F.transform(got["qa"], lambda p, i: item(F.concat(F.lit("naive_q"), (i + 1).cast("string")), p["q"], p["a"]))
    whole = F.array(item(F.lit("naive_oneshot"), F.lit("Thumbnail-only diagnosis (no graph)"), F.trim(t)))
    steps = F.when(F.size(got["qa"]) > 0, some).otherwise(whole)
    return F.when(got["final"] != "", F.array_append(steps, item(F.lit("naive_final"), F.lit("Final impression"), got["final"]))).otherwise(steps)


def section_chunks(t: Column) -> Column:
    """Sections (letter, title, body) of ``X. Title`` lines: cut at a References line, citation digits removed."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), t), r"\n(?=[A-Z]\. )"), lambda s: F.regexp_like(s, F.lit(r"^[A-Z]\. ")))
    body = lambda s: F.regexp_replace(F.trim(F.split(F.regexp_replace(s, r"^[^\n]*\n?", ""), "\nReferences\n")[0], F.lit(" \n")), r"(?<=[a-zA-Z)])\.(\d{1,2}(,\d{1,2})*)\b", ".")
    return F.transform(parts, lambda s: F.struct(F.substring(s, 1, 1).alias("letter"), F.trim(F.regexp_extract(s, r"^[A-Z]\.\s+([^\n]*)", 1)).alias("title"), body(s).alias("body")))


def shorten(t: Column, n: int) -> Column:
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)


def padded(n: Column) -> Column:
    """A number's digits padded to four; longer ones stay whole."""
    return F.lpad(n, F.greatest(F.length(n), F.lit(4)), F.lit("0"))


def specimen(t: Column) -> Column:
    """(prefix, number, block) of a specimen name such as AB-12-3, the number padded to four digits."""
    pat = r"^([A-Za-z]+)[-_ ]?(\d+)(?:[-_ ](\w+))?"
    g = lambda i: F.regexp_extract(t, pat, i)
    return F.struct(F.upper(g(1)).alias("prefix"), padded(g(2)).alias("number"), g(3).alias("block"))

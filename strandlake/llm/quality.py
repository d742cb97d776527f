"""Quality rules with adaptive thresholds (operator 3), in DataFrame functions only.

Each text gets counts; texts that fail the two base rules go. Of the rest, three ratios
(word length, symbols a word, repeated lines a line) are summed up in mergeable KLL quantile
sketches per language and source. A group's sketches give quartiles, the quartiles give
fences, and a text beyond a fence of its group goes too. A group with few texts takes the
fences of its language, whose sketch is its sources' sketches merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut

#: Items a sketch keeps a level: exact up to so many texts, then within about 0.1 % of rank.
SKETCH_K = 2048
#: Texts below which a group takes its language's fences.
LEAST_GROUP = 30
#: Fences stand so many interquartile ranges from the quartiles, and at least this far.
REACH = 3.0
SPREAD = {"word_length": 2.5, "symbol_ratio": 0.1, "dup_line_ratio": 0.5}


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs of anything but ASCII white space. n_lines counts \\n-split lines with a
    word, n_dup_lines those equal to an earlier one. n_repeat_words counts the words in
    5-word windows that occur twice or more in the text (by 64-bit hash of the words). A
    null or empty text has zeros everywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spaces, symbols = " \t\n\x0b\x0c\r", "#*$%&|<>"
    bare = F.translate(text, spaces, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, spaces, "") != "")
    made = ("_words", "_lines", "_grams", "_runs", "_at", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    others = [c for c in docs.columns if c not in (text_col, *made)]
    d = docs.select(
        *others,
        F.array_remove(F.split(F.translate(text, spaces, " " * 6), " +"), "").alias("_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, symbols, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    w = F.col("_words")
    d = d.select(
        *others, "word_chars", "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).alias("_grams"),
    )
    g = F.col("_grams")
    d = d.withColumn("_runs", F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    r = F.col("_runs")
    twice = F.transform(r, lambda e, k: F.when((k > 0) & (e["x"] == F.get(r, F.greatest(k - 1, F.lit(0)))["x"]) | (e["x"] == F.get(r, k + 1)["x"]), e["i"]))
    d = d.withColumn("_at", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    at = F.col("_at")
    steps = F.transform(at, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - p, F.lit(5))).cast("long"))
    repeat = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long"))
    return d.select(*others, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeat.alias("n_repeat_words"))


#: Ratios of two counts.
METRICS = {"word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines")}


def _ratio(metric: str) -> Column:
    a, b = METRICS[metric]
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def fences(judged: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by all keys, by the first key): n and, for each metric, lo and hi."""
    groups = cut(judged.groupBy(*keys).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in METRICS]))
    whole = groups.groupBy(keys[0]).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in METRICS])

    def bounds(df: DataFrame, by: list[str]) -> DataFrame:
        out = []
        for m in METRICS:
            q1, q3 = (F.kll_sketch_get_quantile_double(m, F.lit(p)) for p in (0.25, 0.75))
            reach = F.greatest((q3 - q1) * REACH, F.lit(SPREAD[m]))
            out += [(q1 - reach).alias(f"{m}_lo"), (q3 + reach).alias(f"{m}_hi")]
        return df.select(*by, "n", *out)

    return bounds(groups, keys), bounds(whole, keys[:1])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """docs without the text, with the counts, base_failed and kept.

    base_failed: under 10 words, or over a fifth of the words in repeated 5-word windows.
    kept: not base_failed and within its group's fences, or its language's where fewer than
    least_group of the group's texts pass the base rules (quartiles of fewer say little). Null languages and sources count as
    empty ones. Fences come from the texts that pass the base rules; every row, repeated or
    not, counts once. No rows give no rows. Columns of the names made here are replaced.
    """
    docs = docs.drop("base_failed", "kept", "_lang", "_source", *[f"_{m}" for m in METRICS])
    base = counts(docs, text_col).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    base = cut(base)
    keyed = base.withColumns({"_lang": F.coalesce(lang_col, F.lit("")), "_source": F.coalesce(source_col, F.lit(""))} | {f"_{m}": _ratio(m) for m in METRICS})
    fit = keyed.filter(~F.col("base_failed")).select("_lang", "_source", *[F.coalesce(f"_{m}", F.lit(0.0)).alias(m) for m in METRICS])
    own, whole = fences(fit, ["_lang", "_source"])
    own = own.filter(F.col("n") >= least_group)
    sides = [f"{m}_{s}" for m in METRICS for s in ("lo", "hi")]
    own = own.select("_lang", "_source", *[F.col(c).alias(f"_own_{c}") for c in sides])
    whole = whole.select("_lang", *[F.col(c).alias(f"_all_{c}") for c in sides])
    d = keyed.join(broadcast_if_small(own), ["_lang", "_source"], "left").join(broadcast_if_small(whole), "_lang", "left")
    inside = F.lit(True)
    for m in METRICS:
        lo, hi = (F.coalesce(f"_own_{m}_{s}", f"_all_{m}_{s}") for s in ("lo", "hi"))
        inside = inside & F.coalesce(F.col(f"_{m}").between(lo, hi), F.lit(True))
    return d.select(*base.columns, (~F.col("base_failed") & inside).alias("kept"))

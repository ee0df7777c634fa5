"""Quality rules with thresholds that adapt to each language and source, with DataFrame functions only.

Mergeable quantile sketches of each metric by language and source give the quartiles; a document is an outlier if it lies far outside
them. These fences replace fixed cutoffs, and are joined to the documents to filter them. Two base rules are fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import core

#: Blanks between words, and symbols.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
#: Metric, and the least distance of its fence from the quartile: a spread of zero is no reason to drop what differs little.
METRICS = {"symbol_share": 0.05, "word_length": 2.0, "dup_line_share": 0.2, "repeat_share": 0.2}
#: Metrics of which low values are outliers too.
BOTH_SIDES = ("word_length",)


def window_hashes(words: Column, size: int) -> Column:
    """The hash of the ``size`` words from each place."""
    n = F.size(words) - (size - 1)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(size)]))


def _covered(places: Column, size: int) -> Column:
    """The number of words in windows of ``size`` at sorted ``places``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(places, zero, lambda acc, p: F.struct((acc["n"] + F.least(p + size - acc["end"], F.lit(size).cast("long"))).alias("n"),
                                                             (p + size).alias("end")))["n"]


def measured(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` (with ``text``) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long; a null text has none of them.

    For repeated windows, hashes are sorted with the window's place in the low 20 bits, so windows of one hash stand together. Where 44 bits
    of the hash don't tell two windows apart, or places need more bits, (hash, place) pairs are sorted instead.
    """
    low = (1 << 20) - 1
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")) != "")
    first = docs.select("*", F.filter(F.split(text, BLANKS), lambda w: w != "").alias("_words"), lines.alias("_lines"))
    second = first.select("*", window_hashes(F.col("_words"), size).alias("_grams"))
    packed = F.sort_array(F.transform("_grams", lambda g, i: g.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    third = second.select("*", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), packed).alias("_sorted"))

    def hash_at(k: Column) -> Column:
        return F.get("_grams", F.get("_sorted", k).bitwiseAND(F.lit(low)).cast("int"))

    def twin(v: Column, k: Column) -> Column:
        """Whether the window has the hash of a neighbour in the order."""
        own = F.get("_grams", v.bitwiseAND(F.lit(low)).cast("int"))
        return F.coalesce(own == hash_at(k - 1), F.lit(False)) | F.coalesce(own == hash_at(k + 1), F.lit(False))

    def mixed(v: Column, k: Column) -> Column:
        """Whether the next window shares the 44 bits but not the hash."""
        return F.coalesce((F.shiftright(v, 20) == F.shiftright(F.get("_sorted", k + 1), 20)) & (
            F.get("_grams", v.bitwiseAND(F.lit(low)).cast("int")) != hash_at(k + 1)), F.lit(False))
    short = F.size("_grams") <= low
    fourth = third.select("*", F.when(F.col("_sorted").isNotNull() & short & (F.size(F.filter("_sorted", mixed)) == 0), F.sort_array(F.transform(
        F.filter("_sorted", twin), lambda v: v.bitwiseAND(F.lit(low))))).alias("_places"))
    pairs = F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i"))))
    fifth = fourth.select("*", F.when(F.col("_sorted").isNotNull() & F.col("_places").isNull(), pairs).alias("_pairs"))
    slow = F.sort_array(F.transform(F.filter("_pairs", lambda p, k: F.coalesce(p["g"] == F.get("_pairs", k - 1)["g"], F.lit(False)) | F.coalesce(
        p["g"] == F.get("_pairs", k + 1)["g"], F.lit(False))), lambda p: p["i"]))
    places = F.coalesce("_places", slow)
    return fifth.select(
        *docs.columns, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), F.lit(0).cast("long")).otherwise(_covered(places, size)).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"))


def fences(rows: DataFrame, by: list[str], reach: float, k: int = 200) -> DataFrame:
    """``by`` with low_<metric> and high_<metric>: quartiles from KLL sketches, moved out by ``reach`` times their distance."""
    sketched = rows.groupBy(*by).agg(*[F.kll_sketch_agg_double(F.col(m), F.lit(k)).alias(m) for m in METRICS])
    quartile = lambda m, q: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
    spread = lambda m: F.greatest((quartile(m, 0.75) - quartile(m, 0.25)) * reach, F.lit(METRICS[m]))
    return sketched.select(*by, *[(quartile(m, 0.75) + spread(m)).alias(f"high_{m}") for m in METRICS],
                           *[(quartile(m, 0.25) - spread(m)).alias(f"low_{m}") for m in BOTH_SIDES])


def quality_rules(docs: DataFrame, reach: float = 4.0, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id",
                  text_col: str = "text", by: tuple = ("lang", "source")) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, outlier, kept), one row per row.

    Base rules: fewer than ``min_words`` words, or over ``max_repeat_percent`` % of the words in repeated 3-word windows. The others are
    judged by the fences of their group, which are learned from all documents that pass the base rules. A null text has no words and
    fails; a null language or source is a group; other columns are left out.
    """
    named = {f"by{i}": c for i, c in enumerate(by)}
    base = 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    counts = materialize(measured(core(docs, doc_id=id_col, text=text_col, **named)).drop("text").withColumn(
        "base_failed", (F.col("n_words") < min_words) | base), "measured")
    ratio = {"symbol_share": F.try_divide("n_symbols", "word_chars"), "word_length": F.try_divide("word_chars", "n_words"),
             "dup_line_share": F.try_divide("n_dup_lines", "n_lines"), "repeat_share": F.try_divide("n_repeat_words", "n_words")}
    groups = [F.coalesce(F.concat(F.lit("="), F.col(n).cast("string")), F.lit("")).alias(n) for n in named]
    rows = counts.select(*groups, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         *[x.alias(m) for m, x in ratio.items()])
    limits = materialize(fences(rows.where(~F.col("base_failed")), list(named), reach), "fences")
    far = F.lit(False)
    for m in METRICS:
        far = far | (F.col(m) > F.col(f"high_{m}"))
    for m in BOTH_SIDES:
        far = far | (F.col(m) < F.col(f"low_{m}"))
    far = F.coalesce(far, F.lit(False))
    return rows.join(limits, list(named), "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         far.alias("outlier"), (~F.col("base_failed") & ~far).alias("kept"))

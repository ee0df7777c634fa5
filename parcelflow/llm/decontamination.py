"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every ``window - gram + 1`` successive word k-grams the one with the smallest hash is kept as a fingerprint, the last one in a tie. Equal
spans of ``window`` words keep equal fingerprints, so any shared window meets in the join of fingerprints. A hit is extended to all windows
around it, and these are joined on their words. Items of fewer words than a window are k-grams of their own length, all of which are kept.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import attach, core, free_name, split_likely

#: Characters between words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """A text's words, in the case they have; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _key(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _positions(n: Column) -> Column:
    """0 .. n-1, or an empty array."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(word_hashes: Column, size: int) -> Column:
    """The hash of the ``size`` word hashes at each position."""
    return F.transform(_positions(F.size(word_hashes) - (size - 1)), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(size)]))


def fingerprints(df: DataFrame, keys: list[str], window: int, gram: int, shorter: list[int]) -> DataFrame:
    """``keys`` with (size, hash, at): winnowed ``gram``-grams of texts with a whole window, and every k-gram of the sizes in ``shorter``.

    ``df`` has ``words``. Words are hashed in lower case, which joins no fewer spans than ASCII lower case does.
    """
    span = window - gram + 1
    hashed = df.select(*keys, F.transform("words", lambda w: F.xxhash64(F.lower(w))).alias("h"))
    grams = hashed.select(*keys, "h", gram_hashes(F.col("h"), gram).alias("g"))
    # the smallest hash of each run, and its last place: windows that share a place give one fingerprint
    least = grams.select(*keys, "h", "g", F.transform(
        _positions(F.size("g") - (span - 1)), lambda i: F.least(*[F.get(F.col("g"), i + j) for j in range(span)])).alias("m"))

    def last_place(m: Column, i: Column) -> Column:
        place = i
        for j in range(1, span):
            place = F.when(F.get(F.col("g"), i + j) == m, i + j).otherwise(place)
        return place
    kept = F.array_distinct(F.transform("m", last_place))
    sets = [F.struct(F.lit(gram).alias("size"), kept.alias("places"), F.col("g").alias("g"))]
    sets += [F.struct(F.lit(k).alias("size"), _positions(F.size("h") - (k - 1)).alias("places"), gram_hashes(F.col("h"), k).alias("g")) for k in shorter]
    each = least.select(*keys, F.inline(F.array(*sets)))
    return each.select(*keys, "size", "g", F.explode("places").alias("at")).select(*keys, "size", F.get("g", F.col("at")).alias("hash"), "at")


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_words, n_hit, items array, hits array<struct<start,end>>): the words of each document that lie in benchmark windows.

    A window is ``window`` successive words of an item, compared in ASCII lower case; a shorter item is one window, one without words none.
    ``key`` is the hash of a document's text. Null and empty texts have no words. Repeated rows get equal results each; a null id is an id; other columns are left out; an empty
    table gives no rows, an empty benchmark no hits.
    """
    text = core(docs, doc_id=id_col, text=text_col)
    keyed = text.select("doc_id", _key(F.col("text")).alias("key"), words(F.col("text")).alias("words"))
    items = core(benchmark, item_id=item_col, text=item_text_col)
    items = items.select("item_id", words(ascii_lower(F.col("text"))).alias("words")).where(F.size("words") > 0)

    # each distinct window once, with its items
    size = F.least(F.size("words"), F.lit(window))
    spots = items.select("item_id", "words", size.alias("size"), F.explode(_positions(F.size("words") - size + 1)).alias("at"))
    windows = materialize(spots.select("item_id", F.array_join(F.expr("slice(words, at + 1, size)"), " ").alias("window"), "size")
                          .groupBy("window", "size").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows")
    shorter = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # fewer than a window's words

    long_items = items.where(F.size("words") >= window)
    short_items = items.where(F.size("words") < window)
    marks = fingerprints(long_items, [], window, gram, []).select("size", "hash")
    for k in shorter:
        own = short_items.where(F.size("words") == k).select(F.lit(k).alias("size"), F.transform("words", lambda w: F.xxhash64(F.lower(w))).alias("h"))
        marks = marks.union(own.select("size", F.explode(gram_hashes(F.col("h"), k)).alias("hash")))
    marks = materialize(marks.distinct(), "marks")

    found = fingerprints(keyed, ["doc_id", "key"], window, gram, shorter).join(marks, ["size", "hash"], "left_semi")
    hits = materialize(found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("size", "at")).alias("found")), "hits")

    # the windows around each hit, with their words
    def around(hit: Column) -> Column:
        exact = hit["size"] != gram
        first = F.when(exact, hit["at"]).otherwise(F.greatest(hit["at"] - (window - gram), F.lit(0)))
        last = F.when(exact, hit["at"]).otherwise(F.least(hit["at"], F.size("words") - window))
        starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        length = F.when(exact, hit["size"]).otherwise(F.lit(window))
        both = F.transform(starts, lambda i: F.struct(i.alias("at"), length.alias("size")))
        return F.concat(both, F.array(F.struct(hit["at"].alias("at"), hit["size"].alias("size")))) if gram in shorter else both
    spans = F.array_distinct(F.flatten(F.transform("found", around)))
    shown = F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["size"].alias("size"),
                                                  ascii_lower(F.array_join(F.slice("words", s["at"] + 1, s["size"]), " ")).alias("window")))
    near = materialize(attach(keyed, hits, ("doc_id", "key")).select(
        "doc_id", "key", F.size("words").cast("long").alias("n_words"), F.when(F.col("found").isNotNull(), shown).alias("spans")), "spans")

    held = near.where(F.size("spans") > 0).distinct().select("doc_id", "key", F.inline("spans"))
    held = held.join(windows, ["window", "size"]).groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("hits", zero, lambda acc, h: F.struct(
        (acc["n"] + F.greatest(h["end"] - F.greatest(h["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], h["end"]).alias("end")))["n"]
    return attach(near.select("doc_id", "key", "n_words"), held, ("doc_id", "key")).select(
        "doc_id", "key", "n_words", F.coalesce(F.when(F.col("hits").isNotNull(), covered), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast(held.schema["items"].dataType)).alias("items"),
        F.coalesce("hits", F.array().cast(held.schema["hits"].dataType)).alias("hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``max_share`` lie in benchmark windows; all their columns, repeated rows included.

    A row is known by its id and its text: one that goes takes no other text of its id, and none without an id, with it.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    marked = contaminated_words(docs, benchmark, **options)
    name = free_name(docs, "key")
    bad = marked.where(F.col("n_hit") > F.col("n_words") * F.lit(max_share)).select(F.col("doc_id").alias("bad_id"), F.col("key").alias(name)).distinct()
    bad = materialize(bad, "contaminated")
    maybe, clean = split_likely(docs.withColumn(name, _key(docs[text_col])), name, bad)  # only rows that may go are joined
    bad = bad.toDF("bad_id", name)  # under new names, as the bitmap is made of it too
    kept = maybe.join(bad, maybe[id_col].eqNullSafe(bad["bad_id"]) & (maybe[name] == bad[name]), "left_anti")
    return clean.unionByName(kept).drop(name)

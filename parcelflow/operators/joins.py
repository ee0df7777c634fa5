"""Joins. No side is broadcast by hint: the optimizer broadcasts by measured size and otherwise shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.session import materialize


def keep_all(dimension: DataFrame, summary: DataFrame, key: str, summary_key: str | None = None,
             zero: list[str] = ()) -> DataFrame:
    """Every dimension row with its summary; ``zero`` columns are 0 where the dimension row has no summary."""
    s = summary.withColumnRenamed(summary_key or key, key).withColumn("__hit", F.lit(True))
    out = dimension.join(s, key, "left")
    fill = {c: F.when(F.col("__hit").isNull(), F.lit(0)).otherwise(F.col(c)) for c in zero}
    return (out.withColumns(fill) if fill else out).drop("__hit")


def join_same(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL, as in a grouping; the keys of ``df`` are kept."""
    o = other.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    on = [df[k].eqNullSafe(o[f"__same_{k}"]) for k in keys]
    return df.join(o, reduce(lambda a, b: a & b, on), how).drop(*[f"__same_{k}" for k in keys])


def coalesce_defaults(df: DataFrame, defaults: dict[str, object], rename: dict[str, str] | None = None,
                      keep: list[str] = ()) -> DataFrame:
    """``keep`` columns and the listed ones with NULL replaced, under new names where given."""
    rename = rename or {}
    return df.select(*keep, *[F.coalesce(F.col(c), F.lit(d)).alias(rename.get(c, c)) for c, d in defaults.items()])


def compare_vintages(old: DataFrame, new: DataFrame, key: str, value: str, tags=("y1", "y2"), change: str = "change") -> DataFrame:
    """Full outer comparison of two vintages: both keys, both values and the difference."""
    a, b = tags
    o = old.select(F.col(key).alias(f"{key}_{a}"), F.col(value).alias(f"{value}_{a}"))
    n = new.select(F.col(key).alias(f"{key}_{b}"), F.col(value).alias(f"{value}_{b}"))
    out = o.join(n, F.col(f"{key}_{a}") == F.col(f"{key}_{b}"), "full")
    return out.withColumn(change, F.col(f"{value}_{b}") - F.col(f"{value}_{a}"))


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key in as many tasks as a shuffle has: for steps whose tasks hold what they read, and so must not be put together by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def only_in_each(left: DataFrame, right: DataFrame, on: list[str], names=("first", "second"), side: str = "side") -> DataFrame:
    """Rows of either table without partner in the other; a row with a NULL key has none.

    Both tables are sorted once, together: a key is kept where all its rows are of one side. The tables are dealt out to all tasks.
    """
    tag = lambda df, name, first: dealt(df, on).withColumns({side: F.lit(name), "__first": F.lit(first)})
    both = tag(left, names[0], True).unionByName(tag(right, names[1], False))
    of_key = Window.partitionBy(*on)
    marked = both.withColumns({"__any": F.max("__first").over(of_key), "__all": F.min("__first").over(of_key)})
    alone = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on], F.col("__any") == F.col("__all"))
    return marked.where(alone).drop("__first", "__any", "__all")


def in_set(df: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    return df.join(members.select(*on).distinct(), on, "left_semi")


def lookup(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    return df.join(table, on, "left")


def pair_status(pairs: DataFrame, links: DataFrame, a="A", b="B", out="LINK_HWYNET_STATUS") -> DataFrame:
    """OK if the directed pair is a link, CHECK_DIR if only the reverse is, LINK_MISSING otherwise.

    Both directions are folded on the unordered pair first, so that one join answers both questions.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    known = (links.select(low.alias("__lo"), high.alias("__hi"), (F.col(a) <= F.col(b)).alias("__up"))
             .groupBy("__lo", "__hi").agg(F.max(F.col("__up").cast("int")).alias("__has_up"),
                                          F.max((~F.col("__up")).cast("int")).alias("__has_down")))
    out_df = pairs.withColumn("__lo", low).withColumn("__hi", high).join(known, ["__lo", "__hi"], "left")
    same = F.when(F.col(a) <= F.col(b), F.col("__has_up")).otherwise(F.col("__has_down"))
    status = F.when(same == 1, "OK").when(F.col("__has_up").isNotNull(), "CHECK_DIR").otherwise("LINK_MISSING")
    return out_df.withColumn(out, status).drop("__lo", "__hi", "__has_up", "__has_down")


def base_future(base: DataFrame, future: DataFrame, key: str | list[str], shared: list[str], by="BY", fy="FY") -> DataFrame:
    """Inner join of two years on one or more keys, columns prefixed except the shared ones of the future year."""
    keys = [key] if isinstance(key, str) else key
    b = base.select(*keys, *[F.col(c).alias(by + c) for c in base.columns if c not in keys and c not in shared])
    f = future.select(*keys, *[F.col(c).alias(c if c in shared else fy + c) for c in future.columns if c not in keys])
    return b.join(f, keys)


def merge_on_key(frames: list[DataFrame], key: str) -> DataFrame:
    """Inner merge of several wide frames on one key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def calc_field(df: DataFrame, out: str, op: str, *args) -> DataFrame:
    """Field calculator: constant, copy, add, multiply."""
    c = [F.col(a) if isinstance(a, str) else F.lit(a) for a in args]
    value: Column = {"constant": lambda: c[0], "copy": lambda: c[0], "add": lambda: c[0] + c[1],
                     "multiply": lambda: c[0] * c[1]}[op]()
    return df.withColumn(out, value)


def _set_classes(u: DataFrame) -> DataFrame:
    """(class, owner, size, bits): owners with equal sets, known by their size and two sums of hashes of their items, have the least of them as class.

    ``bits`` has one of 64 bits set for each item, by its hash: a set that contains another has all of its bits.
    """
    h = lambda *c: F.xxhash64(*c, F.col("__i"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h(F.lit(2)), F.lit(64)).cast("int"))
    known = u.groupBy("__o").agg(F.count(F.lit(1)).alias("__size"), F.bit_xor(h()).alias("__x"), F.bit_xor(h(F.lit(1))).alias("__y"), F.bit_or(bit).alias("__bits"))
    known = materialize(known, "set-hashes")
    least = known.groupBy("__size", "__x", "__y").agg(F.min("__o").alias("__class"))
    return known.join(least, ["__size", "__x", "__y"]).select("__class", "__o", "__size", "__bits")


def _rarest(sets: DataFrame, prefix: int) -> DataFrame:
    """(class, size, bits, item, at): the ``prefix`` rarest items of each set, numbered from 1."""
    freq = sets.groupBy("__i").agg(F.count(F.lit(1)).alias("__f"))
    order = Window.partitionBy("__class").orderBy("__f", "__i")
    rare = sets.join(freq, "__i").withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= prefix)
    return rare.select("__class", "__size", "__bits", "__i", "__at")


def _containers(sets: DataFrame, rare: DataFrame, prefix: int) -> DataFrame:
    """(small, big, size): pairs of sets where the larger one has all bits and all rarest items of the smaller one."""
    big = sets.select(F.col("__class").alias("__big"), "__i")
    room = sets.select(F.col("__class").alias("__big"), "__i", F.col("__size").alias("__room"), F.col("__bits").alias("__has"))
    small = rare.select(F.col("__class").alias("__small"), "__size", "__bits", "__i", "__at")
    pairs = small.where("__at = 1").join(room, "__i").where("__room > __size AND (__bits & __has) = __bits").select("__small", "__big", "__size")
    for k in range(2, prefix + 1):
        item = small.where(F.col("__at") == k).select("__small", "__i")
        pairs = pairs.join(item, "__small", "left").join(big.select("__big", "__i", F.lit(True).alias("__has")), ["__big", "__i"], "left").where(
            "__i IS NULL OR __has").select("__small", "__big", "__size")
    return pairs


def contained_sets(items: DataFrame, owner: str, item: str, prefix: int = 4) -> DataFrame:
    """Ordered pairs (a, b) of different owners where one's items are a subset of the other's. NULL items count for nothing.

    Owners with equal sets are one set, named by the least of them, while sets are compared. A set that contains another is larger, has all bits
    of its hashed items and all of its ``prefix`` rarest items: the rarest one gives the pairs, of which only those with all bits leave the join,
    each further one leaves only those that have it too, and what is left is decided by counting common items. Sets that merely share a common
    item never meet.
    """
    u = materialize(items.select(F.col(owner).alias("__o"), F.col(item).alias("__i")).where(F.col("__i").isNotNull()).distinct(), "set-items")
    classes = materialize(_set_classes(u), "set-classes")
    one = classes.where("__o = __class").drop("__class")
    sets = materialize(u.join(one, "__o").select(F.col("__o").alias("__class"), "__size", "__bits", "__i"), "sets")
    rare = materialize(_rarest(sets, prefix), "rarest")
    cand = materialize(_containers(sets, rare, prefix), "containers")
    has = sets.select(F.col("__class").alias("__big"), "__i")
    common = (cand.join(sets.select(F.col("__class").alias("__small"), "__i"), "__small").join(has, ["__big", "__i"])
              .groupBy("__small", "__big", "__size").agg(F.count(F.lit(1)).alias("__c")).where("__c = __size"))
    member = lambda c, o: classes.select(F.col("__class").alias(c), F.col("__o").alias(o))
    pairs = common.select("__small", "__big").join(member("__small", "a"), "__small").join(member("__big", "b"), "__big").select("a", "b")
    equal = member("__class", "a").join(member("__class", "b"), "__class").where("a != b").select("a", "b")
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(equal)

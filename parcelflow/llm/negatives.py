"""Hard-negative mining with anchor-clustered shared lists.

Anchors are clustered by direction. For a cluster with a centre and a radius (the largest angle between the centre and a member), a row at
angle ``t`` from the centre scores at most ``|anchor| * |row| * cos(max(0, t - radius))`` with any member. The rows in order of that bound
are the cluster's list, which all its members share. The list is kept in pages of rows of like direction: each page carries its largest
bound for each cluster, so a page is opened only for clusters with a member that it can still serve, and within a page the rows are sorted
by bound once and the members walk them in blocks. A member stops where its bound falls below the worst score that it still needs, so what
it leaves unread is certified to be of no use. Own pages are walked first, which gives the needs with which all others are judged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import materialize, release
from .rows import core

#: Scores are whole numbers; beyond these they are taken as these. NOTHING is a need that no score meets.
MOST = (1 << 62) - 1
NOTHING = 1 << 62
#: Added to radii, so that rounding can't make a bound too low.
SLACK = 1e-6
WALK = 512


def usable(vector: Column) -> Column:
    """True for a vector without null, infinite or undefined components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def quantized(vector: Column, scale: int = 256) -> Column:
    """Components as whole numbers: floor of ``scale`` times the component, as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _grid(vectors, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    lengths = [len(v) for v in vectors]
    width = max([0, *lengths]) if width is None else width
    out = np.zeros((len(lengths), max(width, 1)), dtype=np.int64)
    if lengths and min(lengths) == width and width:
        out[:] = np.stack(vectors)
    else:
        for i, v in enumerate(vectors):
            out[i, :min(len(v), width)] = v[:width]
    return out


def inner(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as whole numbers within ``MOST``."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    x, y = left.astype(np.float64), right.astype(np.float64)
    if np.sqrt((x * x).sum(axis=1).max() * (y * y).sum(axis=1).max()) < 2 ** 52:  # no sum of parts can round
        return (x @ y.T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


def _directions(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = grid.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norms == 0, 1, norms)[:, None], norms


def _cosines(directions: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = min(directions.shape[1], centres.shape[1])  # what one side lacks is zero
    return np.clip(directions[:, :width] @ centres[:, :width].T, -1, 1)


def fit_centres(vectors: list, clusters: int, rounds: int = 8) -> np.ndarray:
    """Directions of cluster centres, spherical k-means; the first ones lie far from one another."""
    found, norms = _directions(_grid(vectors))
    found = found[norms > 0]
    if not len(found):
        return np.eye(1)
    centres, nearest = found[:1], _cosines(found, found[:1])[:, 0]
    while len(centres) < clusters and nearest.min() < 1 - 1e-9:
        centres = np.vstack([centres, found[nearest.argmin()]])
        nearest = np.maximum(nearest, _cosines(found, centres[-1:])[:, 0])
    for _ in range(rounds):
        own = _cosines(found, centres).argmax(axis=1)
        sums = np.stack([found[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        lengths = np.linalg.norm(sums, axis=1)
        centres = np.where(lengths[:, None] > 1e-9, sums / np.where(lengths == 0, 1, lengths)[:, None], centres)
    return centres


def _bounds(grid: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Rows x clusters: the most that a row can score with a member of length 1."""
    directions, norms = _directions(grid)
    angles = np.arccos(_cosines(directions, centres)) - (radii + SLACK)[None, :]
    bounds = norms[:, None] * np.cos(np.maximum(angles, 0))
    return bounds + 1e-9 * np.abs(bounds)


def _first(group: np.ndarray, scores: np.ndarray, none: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of each group, by score, then id."""
    order = np.lexsort((ids, none, -scores, group))
    ordered = group[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, dtype=np.int64)
    rank = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[rank < count]


def _walk(members: pd.DataFrame, queries: np.ndarray, rows: pd.DataFrame, grid: np.ndarray, bounds: np.ndarray, needs: np.ndarray, low: np.ndarray,
          high: np.ndarray, same_label: bool, count: int) -> pd.DataFrame:
    """The first ``count`` rows for each slot of each member: scores from ``low`` to ``high`` (members x slots); ``needs`` is the least score that
    a member can still use."""
    order = np.argsort(-bounds, kind="stable")
    norms = _directions(queries)[1]
    labels, places, keys = rows["label"].to_numpy(), rows["row"].to_numpy(), rows["id"].to_numpy()
    none, own_labels, own = rows["none"].to_numpy(), members["label"].to_numpy(), members["row"].to_numpy()
    slots = low.shape[1]
    least, needs = low.copy(), needs.astype(np.float64)
    kept = {k: np.empty(0, dtype=np.int64) for k in ("group", "score", "at")}
    for start in range(0, len(order), WALK):
        at = order[start:start + WALK]
        walking = np.flatnonzero(norms * bounds[at[0]] + SLACK >= needs)
        if not len(walking):
            break
        scores = inner(queries[walking], grid[at])
        alike = own_labels[walking][:, None] == labels[at][None, :]
        wanted = (alike & (own[walking][:, None] != places[at][None, :])) if same_label else ~alike
        news = []
        for s in range(slots):
            x, y = np.nonzero(wanted & (scores >= least[walking, s][:, None]) & (scores <= high[walking, s][:, None]))
            news.append((walking[x] * slots + s, scores[x, y], at[y]))
        kept = {k: np.concatenate([kept[k], *[n[j] for n in news]]) for j, k in enumerate(("group", "score", "at"))}
        pick = _first(kept["group"], kept["score"], none[kept["at"]], keys[kept["at"]], count)
        kept = {k: v[pick] for k, v in kept.items()}
        # a slot that is full needs its worst score or more from now on
        groups, sizes = np.unique(kept["group"], return_counts=True)
        worst = np.full(low.size, np.iinfo(np.int64).max)
        np.minimum.at(worst, kept["group"], kept["score"])
        full = groups[sizes == count]
        least.ravel()[full] = np.maximum(least.ravel()[full], worst[full])
        needs = np.maximum(needs, np.where(least <= high, least, NOTHING).min(axis=1))
    row, slot = kept["group"] // slots, kept["group"] % slots
    return pd.DataFrame({"anchor": own[row], "slot": slot, "score": kept["score"], "none": none[kept["at"]], "id": keys[kept["at"]], "row": places[kept["at"]]})


FOUND = "anchor long, slot long, score long, none boolean, id long, row long"


def _visit(tasks: DataFrame, pages: DataFrame, anchors: DataFrame, centres: np.ndarray, radii: np.ndarray, same_label: bool, count: int) -> DataFrame:
    """What each task's anchors find on its page. ``tasks``: (page, bundle, clusters)."""
    rows = tasks.select("page", "bundle", "clusters").join(pages.select("page", "row", "id", "none", "label", "v"), "page")
    asked = tasks.select("page", "bundle").join(anchors, "bundle")
    asked = asked.toDF(*asked.columns)  # under new names for Spark, as both sides hold the tasks

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            width = max(len(v) for side in (left, right) for v in side["v"])
            grid, queries = _grid(left["v"], width), _grid(right["v"], width)
            clusters = right["cluster"].to_numpy()
            bounds = _bounds(grid, centres, radii)
            for k in left["clusters"].iloc[0]:
                of = np.flatnonzero(clusters == k)
                if len(of):
                    side = right.iloc[of]
                    out.append(_walk(side, queries[of], left, grid, bounds[:, k], side["need"].to_numpy(), np.stack(side["low"]), np.stack(side["high"]),
                                     same_label, count))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "slot": [], "score": [], "none": [], "id": [], "row": []}).astype(
            {"anchor": "int64", "slot": "int64", "score": "int64", "none": "bool", "id": "int64", "row": "int64"})
    return rows.groupBy("page", "bundle").cogroup(asked.groupBy("page", "bundle")).applyInPandas(run, FOUND)


def _best(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "none", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _search(places: DataFrame, pages: DataFrame, anchors: DataFrame, centres: np.ndarray, radii: np.ndarray, same_label: bool, count: int, label: str) -> DataFrame:
    """(anchor, slot, score, none, id, row, rank): own pages first, then every other page that can still hold a score that is needed.

    ``anchors`` has low and high, the scores that each slot takes. ``places``: (page, own, cluster, bound).
    """
    lowest = F.array_min(F.filter(F.zip_with("low", "high", lambda a, b: F.when(a <= b, a)), lambda x: x.isNotNull()))
    asked = anchors.withColumn("need", F.coalesce(lowest, F.lit(NOTHING)))
    open_ = asked.where(F.col("need") <= MOST)

    def tasks(of: DataFrame, own: bool) -> DataFrame:
        # a bound of 0 or less can't be scaled by a length, so such needs open every page
        ask = F.when((F.col("need") > 0) & (F.col("norm") > 0), (F.col("need") - SLACK) / F.col("norm")).otherwise(
            F.when((F.col("need") > 0), F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
        needed = of.groupBy("bundle", "cluster").agg(F.min(ask).alias("least"))
        near = places.join(needed, "cluster").where((F.col("own") == F.col("cluster")) == F.lit(own)).where(F.col("bound") >= F.col("least"))
        return materialize(near.groupBy("page", "bundle").agg(F.sort_array(F.collect_list("cluster")).alias("clusters")), f"{label}-tasks")
    first = tasks(open_, True)
    found = materialize(_best(_visit(first, pages, open_, centres, radii, same_label, count), count), f"{label}-own")
    worst = found.groupBy("anchor", "slot").agg(F.min("score").alias("worst"), F.count("*").alias("n")).where(F.col("n") == count)
    worst = worst.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct(F.col("slot").cast("int"), "worst"))).alias("worst"))
    raised = open_.join(worst, open_["row"] == worst["anchor"], "left").drop("anchor")
    raised = raised.withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.try_element_at(F.col("worst"), i))))
    raised = materialize(raised.withColumn("need", F.coalesce(lowest, F.lit(NOTHING))).drop("worst"), f"{label}-needs")
    second = tasks(raised, False)
    more = _visit(second, pages, raised, centres, radii, same_label, count)
    out = materialize(_best(found.drop("rank").unionByName(more), count), label)
    release(first, found, raised, second)
    return out


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, clusters: int = 16,
                        sample: int = 4096, bundle: int = 4096, page: int = 8192, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchors`` holds.

    A score is the inner product of two vectors of whole numbers (see ``quantized``); higher ones come first, equal ones by smaller id, a null
    id last. An anchor's positives are the first ``positives`` other rows of its label, its negatives for each of them the first ``negatives``
    rows of another label that score from ``low`` to ``high`` per cent of the positive's score; a positive without any gives no row. Rows with
    a null label or an unusable vector take no part. Each row counts for itself, repeated ones too, and ids need not be unique; a null id is no
    anchor unless ``anchors`` says so. Vectors of different length compare as if the shorter ended in zeros; scores beyond 2**62 - 1 count as that.
    Ids and labels are whole numbers; other columns are left out; without rows or anchors there is no result.

    Cluster centres are fitted on at most ``sample`` anchors, those with the smallest hash; all anchors and all rows are then searched exactly,
    whatever the centres. A task holds a page of about ``page`` rows and a bundle of about ``bundle`` anchors.
    """
    spark = rows.sparkSession
    spare = F.xxhash64(F.col("id"), F.col("row"))
    plain = core(rows.withColumn("_chosen", F.coalesce(anchors, F.lit(False))), id=id_col, label=label_col, v=vector_col, chosen="_chosen")
    plain = plain.where(F.col("label").isNotNull() & usable(F.col("v")))
    ready = materialize(plain.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("id", F.lit(0)).cast("long").alias("id"), F.col("id").isNull().alias("none"),
        F.col("label").cast("long").alias("label"), F.transform("v", lambda x: x.cast("long")).alias("v"), "chosen"), "vectors")
    some = ready.where("chosen").select("v", F.xxhash64("id", "row").alias("h")).orderBy("h").limit(sample).collect()
    centres = fit_centres([np.asarray(r["v"], dtype=np.int64) for r in some], clusters)

    def place(batches):
        for batch in batches:
            grid = _grid([np.asarray(v, dtype=np.int64) for v in batch.column("v").to_numpy(zero_copy_only=False)])
            directions, norms = _directions(grid)
            cosines = _cosines(directions, centres)
            own = cosines.argmax(axis=1) if len(grid) else np.empty(0, dtype=np.int64)
            extra = [pa.array(own, pa.int64()), pa.array(np.arccos(cosines[np.arange(len(own)), own]), pa.float64()), pa.array(norms, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "cluster", "angle", "norm"])
    placed = materialize(ready.mapInArrow(place, StructType([
        *ready.schema.fields, StructField("cluster", LongType()), StructField("angle", DoubleType()), StructField("norm", DoubleType())])), "placed")

    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.count(F.when(F.col("chosen"), 1)).alias("asked"),
                                          F.max(F.when(F.col("chosen") & (F.col("norm") > 0), F.col("angle"))).alias("radius")).collect()  # a row per cluster
    radii, dealt, filled, at = np.zeros(len(centres)), [], bundle, -1
    for r in sorted(sizes, key=lambda r: -r["asked"]):
        radii[r["cluster"]] = r["radius"] or 0.0
        n = -(-r["asked"] // bundle)
        if filled + r["asked"] > bundle:  # a large cluster fills bundles of its own; small ones share one
            at, filled = at + 1, 0
            start, at = at, at + max(n, 1) - 1
        else:
            start = at
        filled += r["asked"]
        dealt.append((r["cluster"], start, max(n, 1), -(-r["n"] // page)))
    deal = spark.createDataFrame(dealt, "cluster long, first_bundle long, bundles long, pages long") if dealt else spark.createDataFrame(
        [], "cluster long, first_bundle long, bundles long, pages long")
    dealt_rows = placed.join(deal, "cluster")
    pages = materialize(dealt_rows.select(F.struct("cluster", F.pmod(spare, F.col("pages")).alias("part")).alias("page"), "row", "id", "none", "label", "v"), "pages")
    asked = materialize(dealt_rows.where("chosen").select((F.col("first_bundle") + F.pmod(spare, F.col("bundles"))).alias("bundle"), "cluster", "row", "id", "none",
                                                          "label", "v", "norm"), "anchors")

    def tops(batches):
        for batch in batches:
            grid = _grid([np.asarray(v, dtype=np.int64) for v in batch.column("v").to_numpy(zero_copy_only=False)])
            if len(grid):
                bounds = _bounds(grid, centres, radii)
                frame = pd.DataFrame(bounds).groupby([np.asarray(batch.column(c)) for c in ("own", "part")]).max().stack().reset_index()
                yield pa.RecordBatch.from_arrays([pa.array(frame.iloc[:, i].to_numpy(), t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["own", "part", "cluster", "bound"])
    tops_of = pages.select(F.col("page.cluster").alias("own"), F.col("page.part").alias("part"), "v").mapInArrow(tops, "own long, part long, cluster long, bound double")
    places = materialize(tops_of.groupBy("own", "part", "cluster").agg(F.max("bound").alias("bound")).select(
        F.struct(F.col("own").alias("cluster"), "part").alias("page"), "own", "cluster", "bound"), "places")
    release(ready, placed)

    every = asked.withColumns({"low": F.array(F.lit(-MOST)), "high": F.array(F.lit(MOST))})
    near = _search(places, pages, every, centres, radii, True, positives, "positives")
    bands = near.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("near"))
    lows = F.transform("near", lambda p: F.ceil((p["score"].cast("decimal(38,0)") * low) / 100).cast("long"))
    highs = F.transform("near", lambda p: F.floor((p["score"].cast("decimal(38,0)") * high) / 100).cast("long"))
    empty = F.lit(positives) - F.size("near")
    banded = asked.join(bands, asked["row"] == bands["anchor"]).select(
        *asked.columns, F.concat(lows, F.array_repeat(F.lit(MOST), empty)).alias("low"), F.concat(highs, F.array_repeat(F.lit(-MOST), empty)).alias("high"),
        F.transform("near", lambda p: p["rank"]).alias("ranks"))
    hard = _search(places, pages, banded.drop("ranks"), centres, radii, False, negatives, "negatives")
    told = hard.select("anchor", (F.col("slot") + 1).alias("rank"), F.col("rank").alias("n"), "score", "none", "id")
    given = near.where("score >= 0").select("anchor", F.col("rank").cast("long").alias("rank"), F.col("score").alias("positive_score"),
                                            F.when(~F.col("none"), F.col("id")).alias("positive_id"))
    names = asked.select(F.col("row").alias("anchor"), F.when(~F.col("none"), F.col("id")).alias("anchor_id"))
    return told.join(given, ["anchor", "rank"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("n").alias("rank"), F.when(~F.col("none"), F.col("id")).alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

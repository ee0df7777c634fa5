"""Near-duplicate detection with circulant MinHash, banding and exact Jaccard verification.

One permutation spreads the shingles over 2**32 places; a second one, shifted round by 0, 1, 2, .. places, gives all coordinates of the
signature. Documents with equal shingle sets form one class, and everything after works on classes. Classes that share a band meet in a
bucket. There each is first compared with the bucket's hub, the member that shares most with others; groups of copies of one text are
connected by that alone, in steps that grow with their number. What a group of
buckets that share members still holds in several components is compared in blocks, but for pairs whose components are known to be one. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .rows import core, free_name, likely_in, map_slices, own_cache, split_likely

CACHED_WORDS = 200_000
SIGNATURE_COLUMNS = 2048


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = WordHashes()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a UTF-8 text in ASCII lower case; of all words if they are fewer."""
    words = text.lower().split() if text else []  # bytes split at ASCII blanks only, and have ASCII case only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < size:
        size = len(words)
    n = len(words) - size + 1
    out = _mix64(hashes[:n] + np.uint64(size))
    for j in range(1, size):
        out = _mix64(out + hashes[j:j + n])
    return np.unique(out)


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: the smallest place of the set under the second permutation, for each of its shifts."""
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(hashes), SIGNATURE_COLUMNS):
        places = _permute(hashes[i:i + SIGNATURE_COLUMNS].astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        np.minimum(out, _permute(places[None, :] + shifts, 0x85EBCA6B, 0xC2B2AE35).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """(doc_id, key, n_shingles, class binary, signature binary) of rows (doc_id, key, text); class is 128 bits of the shingle set."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        import xxhash
        own_cache("shingles", _WORDS)
        sets = [shingles(t, size) for t in part["text"].array]
        return pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "n_shingles": [len(s) for s in sets],
                             "class": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                             "signature": [signature(s, coordinates).tobytes() if len(s) else b"" for s in sets]})
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "key", F.col("text").cast("binary").alias("text"))
    arrow = pa.schema([("doc_id", pa.string()), ("key", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("signature", pa.binary())])
    return map_slices(plain, run, "doc_id string, key long, n_shingles long, class binary, signature binary", arrow).withColumn(
        "doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def band_keys(signatures: Column, rows: int) -> Column:
    """array<long>: a hash of each band of ``rows`` coordinates, and of its number."""
    def run(batch: pd.Series) -> pd.Series:
        grid = np.frombuffer(b"".join(batch), dtype=np.uint32).reshape(len(batch), -1, rows).astype(np.uint64)
        out = np.broadcast_to(np.arange(1, grid.shape[1] + 1, dtype=np.uint64), grid.shape[:2])
        for j in range(rows):
            out = _mix64(out + grid[:, :, j] * np.uint64(0xD6E8FEB86659FD93))
        return pd.Series(list(out.view(np.int64)))
    return F.pandas_udf(run, "array<long>")(signatures)


#: Edges that one task takes in a round of ``components``.
EDGES_A_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): the smallest node that can be reached; a written table.

    Alternating large-star and small-star steps, each written to the shared folder, until nothing changes. A round's edges go when the next
    ones are written, and few edges are handled by few tasks.
    """
    def sized(df: DataFrame, n: int) -> DataFrame:
        return df.coalesce(max(1, math.ceil(n / EDGES_A_TASK)))

    def known(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state, now = None, known(edges)
    while now != state:
        n = 2 * now[0]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sized(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), n).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = materialize(sized(sized(small.unionByName(low.select("a", F.col("m").alias("b"))), n).distinct(), n), "edges")
        release(edges)
        edges, state, now = fresh, now, known(fresh)
    out = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        sized(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct(), now[0])), "components")
    release(edges)
    return out


def _across(coordinates: int, percent: int):
    """Compares two blocks of a group: the links between different components, confirmed on full sets.

    Sizes and signatures rule most pairs out; what a signature rules out is five standard errors below the threshold.
    """
    t = percent / 100
    slack = t - 5 * math.sqrt(t * (1 - t) / coordinates)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["block"] == key[1]], rows[rows["block"] == key[2]]]
        grids = [np.frombuffer(b"".join(s["signature"]), dtype=np.uint32).reshape(len(s), coordinates) for s in sides]
        sizes = [s["n_shingles"].to_numpy() for s in sides]
        codes = pd.factorize(pd.concat([s["root"] for s in sides]))[0]
        roots = [codes[:len(sides[0])], codes[len(sides[0]):]]
        classes, hashes = [s["class"].to_numpy() for s in sides], [s["hashes"].to_numpy() for s in sides]
        found = []
        for x in range(len(sides[0])):
            ok = (roots[1] != roots[0][x]) & (100 * np.minimum(sizes[1], sizes[0][x]) >= percent * np.maximum(sizes[1], sizes[0][x]))
            if key[1] == key[2]:
                ok[:x + 1] = False
            at = np.flatnonzero(ok)
            if len(at):
                for y in at[(grids[1][at] == grids[0][x]).mean(axis=1) >= slack]:
                    common = len(np.intersect1d(hashes[0][x], hashes[1][y], assume_unique=True))
                    if 100 * common >= percent * (sizes[0][x] + sizes[1][y] - common):
                        found.append((classes[0][x], classes[1][y]))
        return pd.DataFrame(found, columns=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 128, rows: int = 4, block: int = 1024,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component, component_id), one row per row of ``docs``.

    Texts are linked if 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles (the whole text, if it has fewer
    words); texts without words, and nulls, are linked with nothing. ``component_id`` is the smallest id that can be reached; ``component``
    tells components apart even where ids repeat. A null id counts only where a component has no other; repeated rows are one class;
    other columns are left out; an empty table gives no rows. A pair at the threshold t is missed by the bands with probability
    ``(1 - t**rows) ** (coordinates / rows)``: 5e-8 at 0.8, 6e-11 at 0.85.
    """
    text = core(docs, doc_id=id_col, text=text_col).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketch = materialize(sketches(text, size, coordinates), "sketches")
    classes = materialize(sketch.where("n_shingles > 0").groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature")).select("class", "first.doc_id", "first.key", "n_shingles", "signature"), "classes")

    in_band = classes.select("class", F.explode(band_keys(F.col("signature"), rows)).alias("bucket"))
    in_band = materialize(in_band, "bands")
    crowded = in_band.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = materialize(in_band.join(crowded, "bucket"), "members")
    release(in_band)
    shared = members.groupBy("class").agg(F.sum("members").alias("shared"))
    hubs = members.join(shared, "class").groupBy("bucket").agg(F.max(F.struct("shared", "class")).alias("hub")).select("bucket", F.col("hub.class").alias("hub"))
    stars = members.join(hubs, "bucket").where("class <> hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    stars = materialize(stars, "stars")
    release(members)
    sets = shingle_sets(stars, classes, text, size)
    links = verified(stars, sets, percent)
    found = components(links)

    # groups that hold several components: blocks against blocks
    groups = components(stars)
    release(stars)
    rooted = groups.withColumnRenamed("root", "group").join(found, "node", "left").select(F.col("node").alias("class"), "group", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high")
    rest = rooted.join(mixed.select("group", "members"), "group").join(classes.select("class", "n_shingles", "signature"), "class").join(sets, "class")
    n_blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("class"), n_blocks).cast("int"))
    others = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    tasks = dealt.select("*", F.explode(others).alias("t")).select("group", "t.i", "t.j", "block", "class", "root", "n_shingles", "signature", "hashes")
    more = materialize(tasks.groupBy("group", "i", "j").applyInPandas(_across(coordinates, percent), "a binary, b binary"), "across")
    if not more.isEmpty():
        release(found)
        found = components(links.unionByName(more))
    release(sets, links, groups, more)

    rooted = classes.join(found, classes["class"] == found["node"], "left").select(
        classes["class"], "doc_id", F.coalesce("root", classes["class"]).alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(rooted.join(ids, "root").select("class", F.hex("root").alias("component"), "component_id"), "named")
    release(classes, found)
    whole = sketch.join(named, "class", "left")
    alone = F.concat_ws("-", F.lit("alone"), F.col("doc_id").cast("string"))
    empty = F.col("n_shingles") == 0
    return whole.select("doc_id", "key", "n_shingles", F.when(empty, alone).otherwise(F.col("component")).alias("component"),
                        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def shingle_sets(pairs: DataFrame, classes: DataFrame, text: DataFrame, size: int) -> DataFrame:
    """(class, hashes) of the classes in ``pairs``, from the text of one of their documents, written to the shared folder."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = materialize(wanted.join(classes.select("class", "doc_id", "key"), "class"), "wanted")

    def sets(part: pd.DataFrame) -> pd.DataFrame:
        own_cache("shingles", _WORDS)
        return pd.DataFrame({"class": part["class"], "hashes": [shingles(t, size).view(np.int64) for t in part["text"].array]})
    arrow = pa.schema([("class", pa.binary()), ("hashes", pa.list_(pa.int64()))])
    text = likely_in(text, "key", wanted)  # few texts are wanted: the others needn't be shuffled
    texts = text.join(wanted, text["doc_id"].eqNullSafe(wanted["doc_id"]) & (text["key"] == wanted["key"])).select(
        "class", F.col("text").cast("binary").alias("text"))
    made = materialize(map_slices(texts.dropDuplicates(["class"]), sets, "class binary, hashes array<long>", arrow), "sets")
    release(wanted)
    return made


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are alike enough, written to the shared folder."""
    first = sets.select(F.col("class").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("class").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(first, "a").join(second, "b")
    common = F.size(F.array_intersect("x", "y"))
    alike = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    return materialize(both.where(alike).select("a", "b"), "links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``near_duplicates``, the one with the smallest id, with all its columns; rows without words all stay.

    Of rows with equal ids and texts one stays. Only rows that may go are joined; the others are neither moved nor read twice. Columns of any
    name stay as they are.
    """
    marked = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("n_shingles > 0")
    each = marked.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("lowest"))
    each = materialize(each, "members")
    first = each.where("lowest").groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    goes = ~F.struct("doc_id", "key").eqNullSafe(F.col("first"))
    spare = materialize(each.join(first, "component").where(goes | (F.col("n") > 1)).select("doc_id", "key", goes.alias("goes")), "spare")
    release(each)

    name = free_name(docs, "key")
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    known = spare.select(F.col("doc_id").alias("its_id"), F.col("key").alias(name), "goes")
    maybe, stays = split_likely(keyed, name, known)
    lost = known.where("goes").toDF("its_id", name, "goes")  # under new names, as the bitmap is made of it too
    maybe = maybe.join(lost, maybe[id_col].eqNullSafe(lost["its_id"]) & (maybe[name] == lost[name]), "left_anti")
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    single = maybe.where(~wordless).dropDuplicates([id_col, name])
    return stays.unionByName(single).unionByName(maybe.where(wordless)).drop(name)

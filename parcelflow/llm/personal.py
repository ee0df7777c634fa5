"""Personal data by bootstrapped contextual extraction.

Patterns for e-mail addresses, IP addresses, card and phone numbers give the base spans, and their values are the seeds. The words around a
seed are a lexical pattern. Patterns and the identifier-like values that they surround over the whole corpus form a graph, which Spark scores
in rounds: a pattern is as good as the share of its values that are known, a value as the patterns around it. Values that good patterns agree
on become known in the next round, and the patterns around these can find more. Where a value found so stands, there is a span.
"""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .rows import attach, core, map_slices

#: The base kinds in order, and their patterns. Possessive runs and the looks behind change no match, only the time on long runs.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a discovered span is called.
FOUND = "context"
DIGITS = re.compile(r"[0-9]+")
NOT_DIGITS = re.compile(r"[^0-9]+")
#: Code points on either side in which a pattern's words are looked for, and how many digits make a value look like an identifier.
REACH = 128
LEAST_DIGITS = 5
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@._+/#()-")


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + doubled) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            last = found.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
        last = max(last, start if at < 0 else last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGITS.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


def other_values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what looks like an identifier and overlaps no base span: tokens with ``LEAST_DIGITS`` digits or more."""
    out, last, k = [], 0, 0
    spans = sorted((a, b) for a, _, b in base)
    for m in DIGITS.finditer(text):
        if m.start() < last:
            continue
        start, end = m.start(), m.end()
        while start > last and text[start - 1] in TOKEN:
            start -= 1
        while end < len(text) and text[end] in TOKEN:
            end += 1
        last = end
        while start < end and text[start] in ").-/_":
            start += 1
        while end > start and text[end - 1] in "(.-/_":
            end -= 1
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        apart = all(b <= start or a >= end for a, b in spans[k:k + 4])
        if apart and sum("0" <= c <= "9" for c in text[start:end]) >= LEAST_DIGITS:
            out.append((start, end))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The words around a value: two in front, and one on each side; digits as 0."""
    before = DIGITS.sub("0", text[max(0, start - REACH):start]).lower().split()
    after = DIGITS.sub("0", text[end:end + REACH]).lower().split()
    out = []
    if len(before) >= 2:
        out.append(f"{before[-2]} {before[-1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


SPAN = "array<struct<start:int,kind:int,end:int,value:bigint,patterns:array<bigint>>>"


def find_values(docs: DataFrame) -> DataFrame:
    """(doc_id, key, values) of rows (doc_id, key, text): base spans (kind 0 to 3) and other identifier-like values (kind -1), with the hashes of
    value and patterns."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])
    arrow = pa.schema([("doc_id", pa.string()), ("key", pa.int64()), ("values", pa.list_(span))])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        def number(x: str) -> int:
            return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)
        out = []
        for text in part["text"]:
            text = text or ""
            base = base_spans(text)
            all_of = base + [(a, -1, b) for a, b in other_values(text, base)]
            out.append([{"start": a, "kind": k, "end": b, "value": number(text[a:b].lower()), "patterns": [number(p) for p in patterns(text, a, b)]}
                        for a, k, b in sorted(all_of)])
        return pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "values": out})
    plain = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "key", "text")
    return map_slices(plain, run, f"doc_id string, key long, values {SPAN}", arrow).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def discover(edges: DataFrame, rounds: int, least_seeds: int, least_share: float, least_score: float) -> DataFrame:
    """(value, score, round) of unseen values. ``edges``: distinct (pattern, value, seed).

    A pattern counts if ``least_seeds`` distinct known values or more stand in it and they are ``least_share`` of its values, one unknown more
    than there are; its confidence is that share. A value's score is the chance that not all of its patterns are wrong.
    """
    known = edges.where("seed").select("value").distinct().withColumns({"score": F.lit(1.0), "round": F.lit(0)})
    known = materialize(known, "known")
    for k in range(1, rounds + 1):
        scored = edges.join(known, "value", "left")
        good = scored.groupBy("pattern").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("found"), F.count("score").alias("n_known"), F.count("*").alias("n"))
        good = good.select("pattern", (F.col("found") / (F.col("n") + 1)).alias("share"), "n_known").where(
            (F.col("n_known") >= least_seeds) & (F.col("share") >= least_share)).drop("n_known")
        good = materialize(good, "good-patterns")
        open_ = edges.where("NOT seed").join(known.where("round > 0").select("value"), "value", "left_anti")
        fresh = open_.join(good, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.col("share"))))).alias("score")).where(F.col("score") >= least_score)
        fresh = materialize(fresh.withColumn("round", F.lit(k)), "fresh-values")
        release(good)
        if fresh.isEmpty():
            break
        before, known = known, materialize(known.unionByName(fresh), "known")
        release(before, fresh)
    return known.where("round > 0")


def find_personal_data(docs: DataFrame, rounds: int = 3, least_seeds: int = 3, least_share: float = 0.6, least_score: float = 0.8, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, findings): array<struct<kind,start,end,score>> by start, then kind as listed in ``KINDS`` and ``FOUND`` last; code points, end exclusive.

    Base spans have score 1. A value of another kind is found if patterns induced by known values surround it (see ``discover``); then every
    place where the value stands is a span. Values are compared in lower case and count once in a pattern, however often they stand there.
    Null and empty texts have no findings; repeated rows have equal ones each; a null id is an id; other columns are left out; an empty
    table gives no rows.
    """
    text = core(docs, doc_id=id_col, text=text_col)
    keyed = text.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    found = materialize(find_values(keyed), "personal")
    each = found.where(F.size("values") > 0).select("doc_id", "key", F.inline("values"))
    edges = each.select(F.explode("patterns").alias("pattern"), "value", (F.col("kind") >= 0).alias("seed"))
    edges = materialize(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pattern-values")
    new = discover(edges, rounds, least_seeds, least_share, least_score).select("value", "score")
    more = each.where("kind < 0").select("doc_id", "key", "start", "end", "value").join(new, "value").groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "score")).alias("more"))
    more = materialize(more, "discovered")
    release(edges)
    names = F.array(*map(F.lit, (*KINDS, FOUND)))
    base = F.transform(F.filter("values", lambda v: v["kind"] >= 0), lambda v: F.struct(v["start"].alias("start"), v["kind"].alias("kind"), v["end"].alias("end"),
                                                                                       F.lit(1.0).alias("score")))
    whole = attach(found.select("doc_id", "key", base.alias("base")), more, ("doc_id", "key"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(more.schema["more"].dataType))))
    return whole.select("doc_id", F.transform(every, lambda f: F.struct(F.element_at(names, f["kind"] + 1).alias("kind"), f["start"].alias("start"),
                                                                        f["end"].alias("end"), f["score"].alias("score"))).alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")


def base_findings(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["kind"] != FOUND)

"""Secret scan with ownership frequency over the corpus, with DataFrame functions only.

Candidates are found by pattern in every text. How many distinct owners and repositories a candidate's value has over the whole corpus
then tells widely copied examples (many owners) from live-looking credentials (one owner). Long mixed tokens without a telling name beside
them become findings of their own only if they belong to one owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .rows import attach, core

#: The kinds in order, their patterns, and the length from which a match counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_NAME = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9_-]{20,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "opaque")
FINDING = "struct<kind:int,start:int,end:int,value:bigint>"


def running_before(lengths: Column, block: int = 256) -> Column:
    """The sum of what stands before each element; summed by blocks, so that many elements stay cheap."""
    add = lambda a, b: a + b
    n = F.size(lengths)
    bases = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
                        lambda k: F.aggregate(F.slice(lengths, 1, k * block), F.lit(0), add))
    return F.transform(lengths, lambda _, i: F.get(bases, F.floor(i / block).cast("int")) + F.aggregate(
        F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block), F.lit(0), add))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,match>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches (split) and the matches alternate, so their lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.length(b) + F.length(m))
    spans = F.zip_with(F.arrays_zip(between.alias("b"), running_before(lengths).alias("s")), found, lambda x, m: F.struct(
        (x["s"] + F.length(x["b"])).alias("start"), (x["s"] + F.length(x["b"]) + F.length(m)).alias("end"), m.alias("match")))
    return F.when(F.size(found) > 0, F.slice(spans, 1, F.size(found))).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def candidates(text: Column) -> list[Column]:
    """Findings of each kind in ``KINDS``: array<struct<kind,start,end,value>>, value the hash of what is secret in it."""
    value = lambda m: F.regexp_replace(m, ASSIGN_NAME, "")
    found = [
        F.filter(matches(text, ASSIGN), lambda m: F.length(value(m["match"])) >= ASSIGN_LEAST),
        F.filter(matches(text, ACCESS), lambda m: F.length(m["match"]) >= ACCESS_LEAST),
        matches(text, HEX),
        F.filter(matches(text, OPAQUE), lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[a-z]") & m["match"].rlike("[A-Z]")),
    ]
    return [_findings(x, k, value if k == 0 else lambda m: m) for k, x in enumerate(found)]


def _findings(spans: Column, kind: int, secret) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                                                 F.xxhash64(secret(m["match"])).alias("value")).cast(FINDING))


def ownership(findings: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories) of rows (value, owner, repository); a repository belongs to its owner, a null is one of them."""
    once = findings.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan_secrets(docs: DataFrame, example_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
                 repository_col: str = "doc_id", example_repositories: int = 10) -> DataFrame:
    """(doc_id, findings): array<struct<kind,start,end,verdict,n_owners,n_repositories>> by start, then kind as listed in ``KINDS``.

    A value with ``example_owners`` owners or more, or in ``example_repositories`` repositories or more whoever owns them, is an
    ``example``; another one is ``live`` with a single owner and ``shared`` with more. All matches of
    the first three kinds are findings whatever the verdict; an opaque token is one only if it is live and overlaps none of them. Null and
    empty texts have no findings; repeated rows have equal ones each and count once; other columns are left out.
    """
    text = core(docs, doc_id=id_col, text=text_col, owner=owner_col, repository=repository_col)
    keyed = text.select("doc_id", "owner", "repository", F.coalesce("text", F.lit("")).alias("text"))
    kinds = candidates(F.col("text"))
    found = keyed.select("doc_id", F.xxhash64("text").alias("key"), "owner", "repository", F.concat(*kinds[:3]).alias("base"), kinds[3].alias("opaque"))
    # an opaque token that overlaps a base match is that match
    apart = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (o["start"] < b["end"]) & (b["start"] < o["end"])))
    found = materialize(found.select("doc_id", "key", "owner", "repository", F.concat("base", apart).alias("found")), "candidates")

    each = found.where(F.size("found") > 0).select("doc_id", "key", "owner", "repository", F.inline("found"))
    owned = materialize(ownership(each), "ownership")
    many = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)
    verdict = F.when(many, "example").when(F.col("n_owners") == 1, "live").otherwise("shared")
    judged = each.join(owned, "value").withColumn("verdict", verdict)
    judged = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live"))
    by_row = judged.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "kind", "end", "verdict", "n_owners", "n_repositories")).alias("all"))
    shown = F.transform(F.array_sort("all"), lambda f: F.struct(
        F.element_at(F.array(*map(F.lit, KINDS)), f["kind"] + 1).alias("kind"), f["start"].alias("start"), f["end"].alias("end"),
        f["verdict"].alias("verdict"), f["n_owners"].alias("n_owners"), f["n_repositories"].alias("n_repositories")))
    by_row = by_row.select("doc_id", "key", shown.alias("findings"))
    kind = by_row.schema["findings"].dataType
    return attach(found.select("doc_id", "key"), by_row, ("doc_id", "key")).select("doc_id", F.coalesce("findings", F.array().cast(kind)).alias("findings"))


def listed(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")


def base_findings(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["kind"] != KINDS[3])

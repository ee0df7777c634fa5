"""Transit line files: records that start with ``LINE NAME`` and hold attributes and a signed node list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.constants import LINE_FILE_ITEMS_PER_ROW
from parcelflow.sources.sinks import write_text_parts

# --- fixed values: attribute names of the line file, in output order ------------------------------
LINE_ATTRIBUTES = ["LINE NAME", "LONGNAME", "ONEWAY", "MODE", "FARESYSTEM", "OPERATOR", "COLOR", "CIRCULAR",
                   "TIMEFAC[1]", "TIMEFAC[2]", "TIMEFAC[3]", "TIMEFAC[4]", "TIMEFAC[5]",
                   "HEADWAY[1]", "HEADWAY[2]", "HEADWAY[3]", "HEADWAY[4]", "HEADWAY[5]"]
NODE_LIST_NAMES, TIME_FACTOR_NAMES = ["N", "NODES"], ["TF", "TIMEFAC"]
NODE_COLUMNS = ["line_name", "node", "seq", "stop", "tf"]
WHOLE, REAL = ["mode", "color", "operator", "faresystem"], [f"{a}{i}" for a in ("timefac", "headway") for i in range(1, 6)]


def column_name(attribute: str) -> str:
    return attribute.lower().replace(" ", "_").replace("[", "").replace("]", "")


def line_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per transit line: file position and comma-separated items.

    The reader splits files at line-start ``LINE NAME``, so a file is cut into as many tasks as its size
    asks for. Comment lines (``;``) and blank lines are dropped, and continuation lines are joined.
    """
    raw = spark.read.option("lineSep", "\nLINE NAME").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), "value")
    text = F.when(F.col("value").rlike(r"\A\s*="), F.concat(F.lit("LINE NAME"), F.col("value"))).otherwise(F.col("value"))
    # indented record starts are not seen by the reader
    raw = raw.select("file", "block", "pos", F.posexplode(F.split(text, r"(?m)(?=^[ \t]*LINE NAME)")).alias("part", "record"))
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    rows = F.transform(F.split("record", r"\r?\n"), strip)
    rows = F.filter(rows, lambda r: (r != "") & ~r.startswith(";"))
    joined = raw.withColumn("body", F.array_join(rows, "")).where(F.col("body").startswith("LINE NAME"))
    items = F.filter(F.transform(F.split("body", ","), strip), lambda t: t != "")
    pair = lambda t: F.struct(
        F.when(t.contains("="), F.trim(F.substring_index(t, "=", 1))).alias("k"),
        F.trim(F.regexp_replace(F.when(t.contains("="), F.get(F.split(t, "="), F.lit(1))).otherwise(t), '^\\s*"|"\\s*$', "")).alias("v"))
    return joined.select("file", "block", "pos", "part", F.transform(items, pair).alias("items"))


def _attribute(name: str):
    """Last value of a named item, NULL if absent or empty."""
    hits = F.filter("items", lambda t: (t["k"] == name) & (t["v"] != ""))
    return F.try_element_at(F.transform(hits, lambda t: t["v"]), F.lit(-1))


def read_line_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, nodes). Missing attributes are '0'; of several records with one name in a file the last counts.

    Period-1 names may come without ``[1]``. A node with a minus sign is not a stop. A time factor applies
    to the nodes after it, and is '0' before the first one.
    """
    rec = line_records(spark, path)
    value = {a: F.coalesce(_attribute(a), _attribute(a.replace("[1]", "")) if a.endswith("[1]") else F.lit(None), F.lit("0"))
             for a in LINE_ATTRIBUTES}
    place = F.struct("block", "pos", "part")
    last = rec.select("file", value["LINE NAME"].alias("line_name"), place.alias("place"), "items")
    last = last.groupBy("file", "line_name").agg(F.max_by("items", "place").alias("items"))
    lines = last.select("line_name", *[value[a].alias(column_name(a)) for a in LINE_ATTRIBUTES if a != "LINE NAME"])
    typed = {c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in ("mode", "color")}
    typed |= {c: F.col(c).try_cast("double") for c in REAL}
    lines = lines.withColumns(typed)

    tok = last.select("file", "line_name", F.posexplode("items").alias("i", "t"))
    is_tf = F.col("t.k").isin(TIME_FACTOR_NAMES)
    is_node = (F.col("t.k").isNull() | F.col("t.k").isin(NODE_LIST_NAMES)) & F.col("t.v").rlike(r"^-?\d+$")
    tok = tok.where(is_tf | is_node).withColumn("new_tf", F.when(is_tf, F.col("t.v")))
    # the items of a line come from one row, so a window over them is no larger than that row
    w = Window.partitionBy("file", "line_name").orderBy("i")
    sofar = F.last("new_tf", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tok = tok.withColumn("tf", F.coalesce(sofar, F.lit("0")))
    n = tok.where(F.col("new_tf").isNull()).withColumn("seq", F.row_number().over(w) - 1)
    nodes = n.select("line_name", F.abs(F.col("t.v").cast("bigint")).cast("string").alias("node"), "seq",
                     F.when(F.col("t.v").startswith("-"), "N").otherwise("Y").alias("stop"), "tf")
    return lines, nodes


def _number_text(c: str):
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("0")), r"\.0$", "")


def line_file_rows(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text rows of a line file: (line_name, section, row, text), to be written in that order.

    Attributes come first, then nodes, eight items per row. A time factor is written where it changes:
    after the first node of a line (a list must start with a node), before any other.
    """
    per = LINE_FILE_ITEMS_PER_ROW
    item = lambda a: F.concat(F.lit(f"{a}="), F.concat(F.lit('"'), F.col("line_name"), F.lit('"'))
                              if a == "LINE NAME" else _number_text(column_name(a)))
    attrs = F.array(*[item(a) for a in LINE_ATTRIBUTES])
    head = lines.select("line_name", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit((len(LINE_ATTRIBUTES) - 1) // per)),
        lambda k: F.concat(F.array_join(F.slice(attrs, k * per + 1, F.lit(per)), ", "), F.lit(",")))).alias("row", "text"))
    head = head.select("line_name", F.lit(0).alias("section"), F.col("row").cast("bigint").alias("row"), "text")

    # a line is one record of the reader, so its nodes fit one task: one window a line
    known = nodes.join(lines.select("line_name"), "line_name", "left_semi")
    line = Window.partitionBy("line_name")
    order = line.orderBy("seq")
    marked = known.withColumns({"first": F.row_number().over(order) == 1, "__pv": F.lag("tf").over(order)})
    marked = marked.withColumn("new_tf", F.when(F.coalesce("__pv", F.lit("0")) != F.col("tf"), F.col("tf")))
    marked = marked.withColumn("width", F.when(F.col("new_tf").isNull(), 1).otherwise(2))
    upto, all_of = F.sum("width").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.sum("width").over(line)
    marked = marked.withColumns({"before": upto - F.col("width"), "last": F.floor((all_of - 1) / per).cast("bigint")})
    sign = F.when(F.col("stop") == "N", F.lit("-")).otherwise(F.lit(""))
    node, tf = F.concat(F.lit("N="), sign, F.col("node").cast("string")), F.concat(F.lit("TF="), F.col("new_tf"))
    items = F.when(F.col("new_tf").isNull(), F.array(node)).when(F.col("first"), F.array(node, tf)).otherwise(F.array(tf, node))
    each = marked.select("line_name", "before", "last", F.posexplode(items).alias("k", "item")).withColumn("at", F.col("before") + F.col("k"))
    rows = each.groupBy("line_name", F.floor(F.col("at") / per).cast("bigint").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("at", "item"))).alias("items"), F.max("last").alias("last"))  # at most eight
    text = F.concat(F.lit("\t"), F.array_join(F.transform("items", lambda t: t["item"]), ", "),
                    F.when(F.col("row") < F.col("last"), F.lit(",")).otherwise(F.lit("")))
    body = rows.select("line_name", F.lit(1).alias("section"), "row", text.alias("text"))
    return head.unionByName(body)


def write_line_file(lines: DataFrame, nodes: DataFrame, path: str) -> None:
    """A folder of text parts; every line lies whole in one part."""
    rows = line_file_rows(lines, nodes)
    write_text_parts(rows, ["line_name"], ["section", "row"], "text", path)


def write_line_tables(lines: DataFrame, nodes: DataFrame, path: str) -> None:
    """Line table and node table as delimited text with the file's attribute names as header."""
    lines.select(*[F.col(column_name(a)).alias(a) for a in LINE_ATTRIBUTES]).write.mode("overwrite").csv(f"{path}/lines", header=True)
    names = dict(zip(NODE_COLUMNS, ["LINE NAME", "N", "SEQ", "STOP", "TF"]))
    nodes.select(*[F.col(c).alias(n) for c, n in names.items()]).write.mode("overwrite").csv(f"{path}/nodes", header=True)


def read_line_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Inverse of ``write_line_tables``."""
    text = lambda p, n: spark.read.csv(f"{path}/{p}", header=True, schema=", ".join(f"`{c}` string" for c in n))
    lines = text("lines", LINE_ATTRIBUTES).select(*[F.col(f"`{a}`").alias(column_name(a)) for a in LINE_ATTRIBUTES])
    lines = lines.withColumns({c: F.col(c).try_cast("int") for c in ("mode", "color")} | {c: F.col(c).try_cast("double") for c in REAL})
    n = text("nodes", ["LINE NAME", "N", "SEQ", "STOP", "TF"])
    nodes = n.select(F.col("`LINE NAME`").alias("line_name"), F.col("N").alias("node"), F.col("SEQ").cast("int").alias("seq"),
                     F.col("STOP").alias("stop"), F.col("TF").alias("tf"))
    return lines, nodes

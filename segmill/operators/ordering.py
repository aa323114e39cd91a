"""Operators that depend on order, as windows over an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS
from .tables import settled

#: What a Markdown line is. (?U) and (?d): white space, letters and digits of all scripts; only \n ends a line.
HEADING = r"(?Ud)^(\s{0,3}#{1,6}\s+)(.*?)(\s+#+\s*)?$"
LIST = r"(?Ud)^(\s*(?:(?:[-+*])|(?:\d+[.)]))\s+(?:\[[ xX]\]\s+)?)(.+?)\s*$"
BLOCKQUOTE = r"(?Ud)^(\s*>\s?)(.+?)\s*$"
ADMONITION = r"(?Ud)^(\s*>?\s*!!!\s+\w+\s*)(.*)$"
FENCE = r"^\s*(```|~~~)"
REFERENCE, SEPARATOR = r"^\s{0,3}\[[^\]]+\]:\s+", r"^\s*\|*\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)*\|*\s*$"


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: Spark filters to one row a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_heading(lines: DataFrame, doc: str, order: str, heading: str) -> DataFrame:
    """Each line with the heading that stands before it."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("current_heading", F.last(F.nullif(F.col(heading), F.lit("")), ignorenulls=True).over(w))


def regions(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Each line's region: front-matter, fence-mark, fenced or text. Front matter opens on the first line and ends at the next ---."""
    w = Window.partitionBy(doc).orderBy(order)
    stripped = F.btrim(line)
    first = F.first(stripped == "---").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rules = F.sum((stripped == "---").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    front = first & (F.coalesce(rules, F.lit(0)) < 2)
    out = lines.withColumns({"_front": front, "_mark": ~front & F.col(line).rlike(FENCE)})
    marks = F.sum(F.col("_mark").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("region", F.when(F.col("_front"), "front-matter").when(F.col("_mark"), "fence-mark").when(marks % 2 == 1, "fenced").otherwise("text")).drop("_front", "_mark")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def skip_line(line: Column) -> Column:
    """Blank lines, table separators, reference definitions, comments and attribute lists."""
    s = stripped(line)
    return (s == "") | (F.contains(s, F.lit("|")) & line.rlike(SEPARATOR)) | line.rlike(REFERENCE) | s.startswith("<!--") | s.startswith("[//]:") | s.startswith("{:")


def markdown_segments(lines: DataFrame, doc: str = "doc_id", order: str = "line_index", line: str = "line") -> DataFrame:
    """(doc, line_index, kind, cell_index, text, level, current_heading, id): one row a segment, numbered along the document.

    A heading's closing marks belong to it only behind white space; a heading without a text gives nothing.
    """
    text = regions(lines, doc, order, line)
    col, none = F.col(line), F.lit(None).cast("int")
    part = lambda p, k: stripped(F.regexp_extract(col, p, k))
    text = text.withColumn("_heading", F.when(F.col("region") == "text", part(HEADING, 2)).otherwise(""))
    text = with_heading(text, doc, order, "_heading").where((F.col("region") == "text") & ~skip_line(col))
    cells = F.transform(F.split(col, r"\|"), lambda c, i: F.struct(F.lit("table_cell").alias("kind"), i.alias("cell_index"), stripped(c).alias("text"), none.alias("level")))
    one = lambda kind, value, level=none: F.array(F.struct(F.lit(kind).alias("kind"), none.alias("cell_index"), value.alias("text"), level.alias("level")))
    found = (
        F.when(col.rlike(HEADING), one("heading", part(HEADING, 2), F.length(F.regexp_replace(F.regexp_extract(col, HEADING, 1), "[^#]", ""))))
        .when(part(ADMONITION, 2) != "", one("admonition_title", F.btrim(part(ADMONITION, 2), F.lit('"'))))
        .when(F.contains(col, F.lit("|")), F.filter(cells, lambda c: (c["text"] != "") & ~c["text"].rlike("^:?-{3,}:?$")))
        .when(col.rlike(BLOCKQUOTE), one("blockquote", part(BLOCKQUOTE, 2)))
        .when(col.rlike(LIST), one("list_item", part(LIST, 2)))
        .otherwise(one("paragraph", stripped(col)))
    )
    out = text.select(doc, order, "current_heading", F.explode(found).alias("s")).select(doc, order, "current_heading", "s.*").where("text <> ''")
    w = Window.partitionBy(doc).orderBy(order, "cell_index")
    return out.withColumn("id", F.row_number().over(w))


def merged_runs(runs: DataFrame, keys: list[str], start: str = "left", end: str = "right", font: str = "font", order: str = "ord") -> DataFrame:
    """Runs of a line joined while the gap to the run before is at most max(72, 8 font sizes)."""
    w = Window.partitionBy(*keys).orderBy(start, order)
    gap = F.col(start) - F.lag(end).over(w)
    opens = F.when(gap <= F.greatest(F.lit(72.0), F.greatest(F.lit(6.0), F.col(font)) * 8.0), 0).otherwise(1)
    marked = runs.withColumn("_open", opens).withColumn("group", F.sum("_open").over(w))
    return marked.groupBy(*keys, "group").agg(F.min(start).alias("left"), F.max(end).alias("right"), F.count("*").alias("runs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, order, "text"))), lambda r: r["text"]), " ").alias("text"))


def ranges(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows, written in the order of keys and `order`: _part is the range of a row, and _at its place in it.

    Ranges hold equal numbers of rows, whatever the values are and however many rows a key has. Rows equal in key and order are
    put in the order of a hash of all their columns.
    """
    by = [*keys, order, "_tie"]
    tied = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    laid = tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    laid = settled(laid.drop("_tie"), "ranges")
    # the id is the partition's number and, in its lower 33 bits, the row's place
    return laid.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))


def totals(laid: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Of a table laid in ranges(), written: its rows with the sums of values over the rows of their key before each."""
    held = {name: f"_v{i}" for i, name in enumerate(values)}
    rows, laid = laid, laid.withColumns({held[n]: v.cast("long") for n, v in values.items()})
    types = [f"_k{i}" for i in range(len(keys))]
    past = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(*past)
    before = Window.partitionBy(*types).orderBy("_part").rowsBetween(*past)  # a row a range
    none = lambda c: F.coalesce(c, F.lit(0))
    sums = laid.groupBy("_part", *(F.col(k).alias(t) for k, t in zip(keys, types, strict=True))).agg(*(F.sum(v).alias(v) for v in held.values()))
    bases = sums.select(F.col("_part").alias("_p"), *types, *(none(F.sum(v).over(before)).alias(f"_b{v}") for v in held.values()))
    on = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, types, strict=True))]
    out = laid.withColumns({f"_i{v}": none(F.sum(v).over(inside)) for v in held.values()}).join(bases, on)
    return out.select(*(c for c in rows.columns if c not in ("_part", "_at")), *((F.col(f"_b{v}") + F.col(f"_i{v}")).alias(n) for n, v in held.items()))


def running_totals(rows: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """rows with the sums of values over the rows before each, in the order of a column within equal keys (nulls are equal, and first in the order).

    Sums run inside ranges of equal numbers of rows; those of whole ranges are added from the ranges before. A key of any share of
    the rows is cut into as many ranges as it fills.
    """
    return totals(ranges(rows, keys, order), keys, values)


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "n") -> DataFrame:
    """rows with their place (from 0) by a column within equal keys (nulls are equal, and first in the order). No window over rows:
    a row's place in its range, less that of its key's first row there, is offset by the key's rows in the ranges before."""
    laid = ranges(rows, keys, order)
    types = [f"_k{i}" for i in range(len(keys))]
    counts = laid.groupBy("_part", *(F.col(k).alias(t) for k, t in zip(keys, types, strict=True))).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*types).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).withColumnRenamed("_part", "_p")
    on = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, types, strict=True))]
    return laid.join(bases, on).withColumn(name, F.col("_base") + F.col("_at")).select(*rows.columns, name)


def fixed_batches(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """rows with the number of their batch of `size` rows in the order of a column within equal keys."""
    return numbered(rows, keys, order, "batch").withColumn("batch", F.floor(F.col("batch") / size))


def page_partitions(pages: DataFrame, items: int, page: str = "page", requested: int | None = None) -> DataFrame:
    """Pages dealt to workers by range: 3, 5 or 10 of them for under 20, under 50 or more pages, never more than pages or items."""
    top = pages.agg(F.max(page).alias("top"))
    wish = F.lit(requested) if requested else F.when(F.col("top") < 20, 3).when(F.col("top") < 50, 5).otherwise(10)
    plan = top.select("top", F.greatest(F.lit(1), F.least(wish, F.lit(items), F.col("top"))).alias("workers")).withColumn("per", F.ceil(F.col("top") / F.col("workers")))
    return pages.crossJoin(F.broadcast(plan)).withColumn("part", F.floor((F.col(page) - 1) / F.col("per")).cast("long")).drop("top", "workers", "per")  # plan is one row

"""Line-oriented parsing as windows: forward fill, blocks, pipe tables, fixed-width tables, sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import collapse


def numbered_lines(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(keys, i, line) of whole texts, lines from 0."""
    return df.select(*keys, F.posexplode(F.split(text, "\r?\n")).alias("i", "line"))


def forward_fill(lines: DataFrame, keys: Sequence[str], order: str, heading: Column, name: str) -> DataFrame:
    """The last heading at or before each line of its file."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def blocks(lines: DataFrame, keys: Sequence[str], order: str, line: str, blank: Column) -> DataFrame:
    """(keys, block, text): runs of lines between blank ones, joined by spaces; gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("block", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda s: s[line])
    return marked.groupBy(*keys, "block").agg(F.array_join(parts, " ").alias("text"))


def pipe_rows(lines: DataFrame, first_cell: str, arity: int | None = None) -> DataFrame:
    """Adds `cells` to lines of pipe tables whose first cell matches; a wrong number of cells raises."""
    rows = lines.where(F.col("line").rlike(rf"^\s*\|\s*{first_cell}\s*\|"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells)
    if arity is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit(f"not {arity} cells: "), F.col("line")))
    return rows.withColumn("cells", F.when(F.size("cells") == arity, F.col("cells")).otherwise(wrong.cast("array<string>")))


def tag_cell(cell: Column) -> Column:
    """A comma list; a dash stands for none."""
    return F.filter(F.transform(F.split(cell, ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "—"))


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fixed_width(lines: DataFrame, keys: Sequence[str], dashes: str) -> DataFrame:
    """(keys, block, cells): columns by the spans of a dash line; a row's cells are joined over its lines."""
    spans, at = [], 0
    for part in dashes.split(" "):
        if part.strip("-") == "" and part:
            spans.append((at, len(part)))
        at += len(part) + 1
    blank = F.trim("line") == ""
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("block", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank)
    cut = F.struct("i", *[F.substring("line", a + 1, n + 1).alias(f"c{k}") for k, (a, n) in enumerate(spans)])
    grouped = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(cut)).alias("rows"))
    cells = [collapse(F.array_join(F.transform("rows", _field(k)), " ")) for k in range(len(spans))]
    return grouped.select(*keys, "block", F.array(*cells).alias("cells"))


def _field(k: int):
    return lambda s: s[f"c{k}"]


def sections(lines: DataFrame, keys: Sequence[str], heading: str, field: str) -> DataFrame:
    """(keys, section, fields): a map of each section's labelled lines; a section that comes twice raises.

    `heading` and `field` are patterns with one and two groups."""
    found = F.regexp_extract("line", heading, 1)
    filled = forward_fill(lines, keys, "i", F.when(found != "", found), "section")
    at = Window.partitionBy(*keys, "section")
    filled = filled.withColumn("_heads", F.sum((found != "").cast("int")).over(at))
    rows = filled.where(F.col("section").isNotNull() & F.col("line").rlike(field))
    entry = F.struct(F.regexp_extract("line", field, 1).alias("key"), F.regexp_extract("line", field, 2).alias("value"))
    out = rows.groupBy(*keys, "section").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"), F.max("_heads").alias("_heads"))
    twice = F.raise_error(F.concat(F.lit("section comes twice: "), F.col("section"))).cast("map<string,string>")
    return out.withColumn("fields", F.when(F.col("_heads") == 1, F.col("fields")).otherwise(twice)).drop("_heads")


def ids_between(texts: DataFrame, keys: Sequence[str], text: str, start: str, end: str, pattern: str) -> DataFrame:
    """(keys, id): ids between two markers."""
    part = F.substring_index(F.substring_index(text, start, -1), end, 1)
    return texts.where(F.contains(text, F.lit(start))).select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(part, F.lit(pattern), F.lit(0)))).alias("id"))


def outline(lines: DataFrame, keys: Sequence[str], order: str = "line", text: str = "raw", levels: int = 3) -> DataFrame:
    """Adds h1 … hN to each line: (title, at) of the heading of each level that is open there, `at` its line.

    A heading closes those of its own and all deeper levels. Headings with equal titles differ in `at`."""
    marks = F.length(F.regexp_extract(text, r"^(#{1,6})\s+\S", 1))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mine = F.struct(F.trim(F.regexp_replace(text, r"^#+\s+", "")).alias("title"), F.col(order).cast("long").alias("at"))
    closed = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("at"))
    out = lines.withColumn("_level", marks)
    for k in range(1, levels + 1):
        mark = F.when(F.col("_level") == k, mine).when(F.col("_level").between(1, k - 1), closed)
        out = out.withColumn(f"h{k}", F.last(mark, ignorenulls=True).over(w))
    return out.withColumn("heading", F.col("_level") > 0).drop("_level")


def bodies(outlined: DataFrame, keys: Sequence[str], level: int, order: str = "line", text: str = "raw") -> DataFrame:
    """(keys, h1 … h<level>, body): the lines below each heading of a level, in order, joined by line breaks; a heading
    without lines has an empty body."""
    heads = [f"h{k}" for k in range(1, level + 1)]
    rows = outlined.where(f"h{level}.at IS NOT NULL")
    held = F.when(~F.col("heading") | (F.col(order) != F.col(f"h{level}.at")), F.struct(order, text))
    grouped = rows.groupBy(*keys, *heads).agg(F.array_sort(F.collect_list(held)).alias("_l"))
    return grouped.select(*keys, *heads, F.array_join(F.transform("_l", lambda s: s[text]), "\n").alias("body"))


def labelled(body: str) -> Column:
    """(label, value) of bold labels, in order and with repeats; values are collapsed and end at the next label."""
    pattern = r"(?s)\*\*([^*]+?):\*\*\s*(.*?)(?=\s*\*\*[^*]+?:\*\*|\z)"
    found = lambda k: F.regexp_extract_all(body, F.lit(pattern), F.lit(k))
    dashes = lambda v: F.replace(F.replace(collapse(F.regexp_replace(v, r"\\(?=\n|$)", "")), F.lit("---"), F.lit("—")), F.lit("--"), F.lit("–"))
    return F.zip_with(found(1), found(2), lambda a, b: F.struct(F.trim(a).alias("label"), dashes(b).alias("value")))


def fields_of(pairs: Column) -> Column:
    """A map of labels, the last value of each."""
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + F.lit(2), F.size(pairs)), lambda y: y["label"] == x["label"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["label"], x["value"])))


def split_field(pairs: Column, label: str, sep: str) -> Column:
    """The items of one label's value."""
    value = F.element_at(fields_of(pairs), F.lit(label))
    return F.filter(F.transform(F.split(value, sep), lambda v: F.trim(v)), lambda v: v != "")

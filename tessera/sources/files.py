"""Scans of corpus files: JSON lines, CSV, Markdown tables and sections, YAML blocks, folders, vector stores."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import schemas
from tessera.functions.text import collapse
from tessera.sources import digests
from tessera.sources.lines import ids_between, last_of, numbered_lines, pipe_rows, sections, tag_cell

#: Bytes of a file that is written to be read by one task.
PART = 1 << 26


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text) of whole files, sub-folders included; a file must fit a task."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def text_lines(spark: SparkSession, path: str, glob: str | None = None, few: bool = False) -> DataFrame:
    """(path, line, raw) of every line, numbered from 1 in its file, however many splits a file is read in.

    A first pass counts the lines of each split, running sums say how many stand before it, and a second pass adds
    the line's place in its split, from the row ids of the scan. Both passes have to cut and pack the files alike; where
    they don't (files that change meanwhile, another number of cores at the second planning), ids fall outside their
    split's range, and the read fails instead of numbering wrongly. With `few`, for files that Spark has written, a row for
    each split is broadcast, and no line is shuffled."""
    rows = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter=glob).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("raw")
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.col("id") - F.col("first")
    wrong = F.raise_error(F.concat(F.lit("split read in two ways: "), F.col("path"), F.lit(" at "), F.col("start").cast("string"))).cast("long")
    number = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place + 1).otherwise(wrong)
    return rows.join(F.broadcast(splits) if few else splits, ["path", "start"], "left").select("path", number.alias("line"), "raw")


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, raw) of non-blank lines, numbered from 1; rules.json_issues tells what is wrong with them."""
    return text_lines(spark, path).where(F.trim("raw") != "")


def cards(spark: SparkSession, path: str, schema: str = schemas.CARD) -> DataFrame:
    """JSON lines by a declared schema; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str, breaks: bool = True) -> DataFrame:
    """S3: verbatim strings: BOM, quotes and line breaks in fields are understood, empty fields stay empty.

    Quoted line breaks make a file one task's work, since a split can't know whether it begins inside quotes; without
    `breaks`, for files that have none, it is read in splits."""
    df = spark.read.csv(path, header=True, multiLine=breaks, escape='"', emptyValue="", nullValue="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return df.na.fill("")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV's first line."""
    return csv(spark, path).columns


def launch_table(spark: SparkSession, path: str) -> DataFrame:
    """Five columns of a pipe table keyed on card ids."""
    rows = pipe_rows(text_lines(spark, path).select("path", F.col("raw").alias("line")), r"C\d{4}", 5)
    names = ("id", "tradition", "work", "location", "philosophical_move")
    return rows.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])


def registry(spark: SparkSession, path: str, id_pattern: str = r"C\d{4}") -> DataFrame:
    """Eleven columns, comma lists in two of them; the last row of an id counts, of those in one file."""
    lines = text_lines(spark, path).select("path", F.col("line").alias("i"), F.col("raw").alias("line"))
    rows = last_of(pipe_rows(lines, id_pattern, 11).withColumn("id", F.get("cells", F.lit(0))), "id", "i")
    names = ("status", "tradition", "author_speaker", "work", "location", "philosophical_move", "perspective", "coordinates", "tensions", "decision")
    cell = lambda k, n: tag_cell(F.get("cells", F.lit(k))) if n in ("coordinates", "tensions") else F.get("cells", F.lit(k))
    return rows.select("id", *[cell(k + 1, n).alias(n) for k, n in enumerate(names)])


def recovery(spark: SparkSession, path: str) -> DataFrame:
    """Sections of labelled fields."""
    lines = text_lines(spark, path).select("path", F.col("line").alias("i"), F.col("raw").alias("line"))
    return sections(lines, ["path"], r"^###\s+(C\d{4})", r"^-\s+\*\*(.+?):\*\*\s*(.*)$").select(F.col("section").alias("id"), "fields")


def unresolved_ids(spark: SparkSession, path: str, start: str = "Unresolved:", end: str = "\n\n## ") -> DataFrame:
    """S12."""
    return ids_between(text_files(spark, path), ["path"], "text", start, end, r"C\d{4}").select("id")


def fenced_blocks(lines: DataFrame, fence: str) -> DataFrame:
    """(path, block, line, body) of fenced blocks with a language name, in files of numbered lines (path, line, raw).

    Blocks are cut by running counts of fences before anything is parsed; one that never ends is left out."""
    upto = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("raw").rlike(rf"^\s*```\s*{fence}\s*$"), F.col("raw").rlike(r"^\s*```\s*$")
    marked = lines.withColumn("block", F.sum(opens.cast("int")).over(upto)).where("block > 0")
    inside = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("ends", F.sum(closes.cast("int")).over(inside))
    text = F.array_sort(F.collect_list(F.when((F.col("ends") == 0) & ~opens, F.struct("line", "raw"))))
    cut = marked.groupBy("path", "block").agg(F.min("line").alias("line"), text.alias("t"), F.max("ends").alias("ends")).where("ends > 0")
    return cut.select("path", (F.col("block") - 1).cast("int").alias("block"), "line", F.concat(F.array_join(F.transform("t", lambda s: s["raw"]), "\n"), F.lit("\n")).alias("body"))


def yaml_records(blocks: DataFrame) -> DataFrame:
    """(path, block, line, state, record, problem) of YAML bodies: records as JSON text, scalars kept as they are written.

    Only null and boolean words mean something, so 2.10 stays text. A block that doesn't parse, or whose list items
    aren't texts, is read again with its plain list items quoted: `repaired`; what still doesn't parse is `refused`.
    Needs a YAML library on the workers; without one the read says so."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        class Plain(yaml.SafeLoader):
            pass

        keep = ("tag:yaml.org,2002:bool", "tag:yaml.org,2002:null")
        Plain.yaml_implicit_resolvers = {c: [r for r in rs if r[0] in keep] for c, rs in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def odd(node) -> bool:
            if isinstance(node, dict):
                return any(map(odd, node.values()))
            return isinstance(node, list) and any(not isinstance(x, str) for x in node)

        def read(body: str) -> tuple[str, str | None, str | None]:
            try:
                found = yaml.load(body, Plain)
                if not odd(found):
                    return "good", json.dumps(found, ensure_ascii=False), None
            except yaml.YAMLError:
                pass
            quoted = re.sub(r"(?m)^(\s*-\s+)(?![\"'])(.*\S)\s*$", lambda m: m[1] + json.dumps(m[2], ensure_ascii=False), body)
            try:
                return "repaired", json.dumps(yaml.load(quoted, Plain), ensure_ascii=False), None
            except yaml.YAMLError as e:
                return "refused", None, str(e).split("\n")[0]

        for pdf in batches:
            pdf[["state", "record", "problem"]] = [read(b) for b in pdf["body"]]
            yield pdf[["path", "block", "line", "state", "record", "problem"]]

    return blocks.select("path", "block", "line", "body").mapInPandas(parse, "path string, block int, line long, state string, record string, problem string")


def yaml_blocks(spark: SparkSession, path: str, fence: str = "yaml") -> DataFrame:
    """(path, block, record) of fenced YAML, good or repaired; a refused block fails the read."""
    found = yaml_records(fenced_blocks(text_lines(spark, path), fence))
    refused = F.raise_error(F.concat(F.lit("YAML block refused at line "), F.col("line").cast("string"), F.lit(": "), "problem"))
    return found.select("path", "block", F.when(F.col("state") != "refused", F.col("record")).otherwise(refused).alias("record"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of the files below a path; a file has to fit a task's memory, and 2 GB."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_parts(rows: DataFrame, path: str, by: str, order: str, text: str) -> None:
    """The texts of each value of `by`, a line each, as files of about PART bytes in a folder of its own: in the order of their numbers."""
    size = rows.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    parts = rows.repartitionByRange(int(size) // PART + 1, by, order).sortWithinPartitions(by, order)
    parts.select(by, text).write.partitionBy(by).text(path)


def folder_hashes(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(name, size, sha256) of what the files of each folder `by`=name hold together, in the order of their numbers.

    A digest is sequential, so a folder's first files are read first, by a task each, then all second ones from the state
    that these left: a task reads a few files, however large a folder is. The driver has the files' names and a
    state for each folder."""
    listed: dict[str, list] = {}
    files_ = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    name = F.regexp_extract("path", rf"/{by}=([^/]*)/", 1)
    for r in files_.load(path).select(name.alias("name"), "path", "length").toLocalIterator():
        number = re.match(r"part-(\d+)", r.path.rsplit("/", 1)[-1])
        listed.setdefault(r.name, []).append((int(number[1]) if number else -1, r.path, r.length))
    states = {folder: digests.start() for folder in listed}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [digests.update(states[n.as_py()], b.address, b.size) for n, b in ((n, c.as_buffer()) for n, c in zip(*batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], ["name", "state"])

    for own in listed.values():
        own.sort()
    for at in range(max(map(len, listed.values()), default=0)):
        now = [own[at][1] for own in listed.values() if at < len(own)]
        states |= {r.name: bytes(r.state) for r in files_.load(now).select(name.alias("name"), "content").mapInArrow(run, "name string, state binary").collect()}
    rows = [(folder, sum(f[2] for f in own), digests.finish(states[folder])) for folder, own in listed.items()]
    return spark.createDataFrame(rows, "name string, size long, sha256 string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of a manifest's lines, comments left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.startswith(F.trim("value"), F.lit("#")) & (F.trim("value") != ""))
    return rows.select(F.get(parts, F.lit(2)).alias("name"), F.get(parts, F.lit(1)).cast("long").alias("size"), F.get(parts, F.lit(0)).alias("sha256"))


def manifest_problems(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(name, problem) of files that lack or differ."""
    both = listed.alias("m").join(files.alias("f"), "name", "left")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("m.sha256") != F.col("f.sha256"), "sha256").when(~F.col("m.size").eqNullSafe(F.col("f.size")), "size")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def require_files(listed: DataFrame, files: DataFrame) -> None:
    """All or nothing: one error that names every listed file that lacks or differs, before any of them is read."""
    bad = manifest_problems(listed, files).limit(51).collect()  # a bounded excerpt for the message
    if bad:
        raise ValueError("sources differ from their manifest: " + ", ".join(sorted(f"{r.name} ({r.problem})" for r in bad[:50])) + (" and more" if len(bad) > 50 else ""))


def overlay_problems(layer: DataFrame, header: Sequence[str], cards_: DataFrame, text: str = "retrieval_text") -> DataFrame:
    """(problem, card_id): what breaks an overlay's contract: header, repeated or unknown ids, blank texts, several versions."""
    none = F.lit(None).cast("string").alias("card_id")
    head = layer.limit(1).select(F.lit("header").alias("problem"), none).where(F.lit(list(layer.columns) != list(header)))
    twice = layer.groupBy("card_id").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "card_id")
    blank = layer.where(F.trim(text) == "").select(F.lit("blank").alias("problem"), "card_id")
    unknown = layer.join(cards_.select("card_id"), "card_id", "left_anti").select(F.lit("unknown").alias("problem"), "card_id")
    versions = layer.agg(F.countDistinct("layer_version").alias("n")).where("n > 1").select(F.lit("versions").alias("problem"), none)
    return head.unionByName(twice).unionByName(blank).unionByName(unknown).unionByName(versions)


def benchmark_cases(spark: SparkSession, path: str, heading: str = r"^###\s+(B\d{2})\b\s*[—-]?\s*(.*)$") -> DataFrame:
    """(id, title, fields, lists): labelled lines as a map, other bullets as a list, of each case."""
    lines = numbered_lines(text_files(spark, path), ["path"], "text")
    from tessera.sources.lines import forward_fill

    found = F.regexp_extract("line", heading, 1)
    title = F.when(found != "", collapse(F.regexp_extract("line", heading, 2)))
    ends = F.col("line").rlike(r"^##\s")
    filled = forward_fill(lines, ["path"], "i", F.when(found != "", found).when(ends, F.lit("")), "id").withColumn("title", title).where("id <> ''")
    field = r"^\s*(?:-\s+)?\*\*(.+?):?\*\*:?\s*(.+)$"
    labelled = F.when(F.col("line").rlike(field), F.struct("i", F.regexp_extract("line", field, 1).alias("k"), F.regexp_extract("line", field, 2).alias("v")))
    item = F.when(F.col("line").rlike(r"^\s*[-*]\s+") & ~F.col("line").rlike(field), F.struct("i", F.regexp_extract("line", r"^\s*[-*]\s+(.*)$", 1).alias("v")))
    g = filled.groupBy("id").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(labelled)).alias("l"), F.array_sort(F.collect_list(item)).alias("b"))
    first = F.filter("l", lambda x, n: ~F.exists(F.slice("l", 1, n), lambda y: y["k"] == x["k"]))
    return g.select("id", "title", F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"]))).alias("fields"), F.transform("b", lambda x: x["v"]).alias("items"))


def vectors(spark: SparkSession, path: str, provider: str, model: str, version: str, dims: int) -> DataFrame:
    """The stored vectors of one configuration, by partition pruning; other dimensions are ignored."""
    v = spark.read.parquet(path)
    return v.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("version") == version) & (F.size("vector") == dims))


def curation(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, id, field, value) updates, one JSON document a file, in the order of file names."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("raw"))
    entries = F.from_json(F.get_json_object("raw", "$.fragments"), "map<string,struct<`set`: map<string,string>>>")
    each = raw.select("file", F.explode(entries).alias("id", "u")).where(F.col("u.set").isNotNull())
    return each.select("file", "id", F.explode("u.set").alias("field", "value"))

"""File sources and sinks: JSON lines, CSV with a byte-order mark, mixed folders, PDF, captions, paged services."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosswork.functions.text import clock_to_ms, squash
from glosswork.operators.durable import ship, written

BAD = "_bad"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, strict: bool = True) -> DataFrame:
    """Rows of JSON lines with their file; blank lines are skipped. With ``strict`` a line that isn't an object of the schema raises, else it goes."""
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where("trim(value) != ''")
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = lines.select(parsed.alias("r"), "_file").select("r.*", "_file")
    if strict and (found := rows.where(F.col(BAD).isNotNull()).limit(1).collect()):
        raise ValueError(f"{found[0]['_file']}: not a record: {found[0][BAD][:200]}")
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows of a CSV with header as strings; a byte-order mark before the first name goes, missing columns raise."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path}: columns {missing} are missing")
    return df


def write_jsonl(df: DataFrame, path: str) -> None:
    """The writer's commit leaves either all files or none."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Only ``columns``, in their order; other columns are left out. Every file begins with a byte-order mark, as spreadsheets ask for."""
    marked = df.select(*[F.col(c).alias(("\ufeff" if i == 0 else "") + c) for i, c in enumerate(columns)])
    marked.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a tab-separated index without header or quotes; a line with another number of fields raises, blank lines go."""
    fields = T.StructType.fromDDL(schema).fields
    parts = spark.read.text(path).where("trim(value) != ''").select(F.split("value", "\t", -1).alias("p"), "value")
    if bad := parts.where(F.size("p") != len(fields)).limit(1).collect():
        raise ValueError(f"{path}: {len(bad[0]['p'])} fields in place of {len(fields)}: {bad[0]['value'][:200]}")
    return parts.select(*[F.col("p")[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def read_records(spark: SparkSession, path: str, at: str, schema: str) -> DataFrame:
    """Rows of JSON documents, a file each: the array of objects under the key ``at``, with the file. A file without it raises."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.from_json("value", f"`{at}` array<struct<{schema}>>").alias("j"))
    if bad := whole.where(F.col("j").isNull() | F.col(f"j.{at}").isNull()).select("_file").limit(1).collect():
        raise ValueError(f"{bad[0][0]}: no array under {at!r}")
    return whole.select("_file", F.inline(f"j.{at}"))


def refuse_overwrite(existing: DataFrame, key: str, answer: str) -> None:
    """Raise if a table that is about to be replaced holds answers."""
    if found := existing.where(F.coalesce(F.col(answer), F.lit("")) != "").select(key).limit(5).collect():
        raise ValueError(f"answers would be lost: {[r[0] for r in found]}")


def forbid_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error if it has any of ``columns``: documents have no timeline."""
    if found := sorted({c.lower() for c in columns} & {c.lower() for c in df.columns}):
        raise ValueError(f"columns {found} don't belong here")
    return df


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def read_mixed(spark: SparkSession, folder: str, ids: tuple[str, ...] = ("doc_id", "id", "url"), texts: tuple[str, ...] = ("text", "body", "content")) -> DataFrame:
    """(doc_id, text, file) of a folder of .jsonl, .json, .txt and .md files.

    Of several candidate keys the first that is filled counts; a record without an id gets its file's stem and its
    number in the file; lines that can't be read go.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("content").cast("string").alias("raw"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    kind = F.regexp_extract("path", r"\.([^./]+)$", 1)
    parsed = "array<map<string,string>>"
    lines = F.transform(F.filter(F.split("raw", "\n"), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, "map<string,string>"))
    array = F.from_json("raw", parsed)
    record = F.when(kind == "jsonl", lines).when(kind == "json", F.coalesce(array, F.array(F.from_json("raw", "map<string,string>")))).otherwise(F.array(F.create_map(F.lit(texts[0]), "raw")))
    rows = whole.where(kind.isin("jsonl", "json", "txt", "md")).select(stem.alias("stem"), "path", F.posexplode(record).alias("i", "r")).where("r is not null")
    get = lambda keys: first_filled(*[F.col("r")[k] for k in keys])
    return rows.select(F.coalesce(get(ids), F.concat("stem", F.lit("#"), "i")).alias("doc_id"), get(texts).alias("text"), F.col("path").alias("file")).where("text is not null")


def _pdf_pages(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF needs pypdf or another function in its place") from e
    import io

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def read_pdf(spark: SparkSession, folder: str, pages=_pdf_pages) -> DataFrame:
    """(file, page, line_number, line) of the .pdf files under a folder, pages and lines from 1; blank lines go, a file that can't be read raises with its name.

    ``pages(content)`` gives the texts of a file's pages; the default needs pypdf on the executors. A page's lines leave a task before
    the next page's are cut.
    """
    ship(spark)
    names = ["file", "page", "line_number", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    texts = pages(content.as_py())
                except ImportError:
                    raise
                except Exception as e:
                    raise ValueError(f"{path.as_py()}: not readable: {e}") from e
                for p, text in enumerate(texts, 1):
                    found = [(n, x.strip()) for n, x in enumerate((text or "").splitlines(), 1) if x.strip()]
                    cols = [pa.array([path.as_py()] * len(found), pa.string()), pa.array([p] * len(found), pa.int32()), pa.array([n for n, _ in found], pa.int32()), pa.array([x for _, x in found], pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, page int, line_number int, line string")


_TIMING = r"^\s*((?:\d{2,}:)?\d{2}:\d{2}\.\d{3})\s+-->\s+((?:\d{2,}:)?\d{2}:\d{2}\.\d{3})"


def parse_captions(files: DataFrame) -> DataFrame:
    """(id, cue_index, start_ms, end_ms, text) of caption files (id, text).

    A timing line begins a cue; the lines after it, up to a blank one, are its text, without tags. Cues without text stay,
    as empty ones, so their number is that of the timing lines.
    """
    lines = files.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("timing", F.col("line").rlike(_TIMING))
    order = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("cue", F.sum(F.col("timing").cast("int")).over(order)).where("cue > 0")
    in_cue = Window.partitionBy("id", "cue").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kept = numbered.withColumn("ended", F.max((F.trim("line") == "").cast("int")).over(in_cue)).where("ended = 0")
    clock = lambda i: F.regexp_extract(F.max(F.when(F.col("timing"), F.col("line"))), _TIMING, i)
    full = lambda c: F.when(F.length(c) < 12, F.concat(F.lit("00:"), c)).otherwise(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("timing"), F.struct("n", "line")))), lambda x: x["line"]), " ")
    cues = kept.groupBy("id", "cue").agg(full(clock(1)).alias("a"), full(clock(2)).alias("b"), text.alias("text"))
    return cues.select("id", (F.col("cue") - 1).cast("long").alias("cue_index"), clock_to_ms(F.col("a")).alias("start_ms"), clock_to_ms(F.col("b")).alias("end_ms"), squash(F.regexp_replace("text", "<[^>]+>", "")).alias("text"))


def paged(spark: SparkSession, pages: int, fetch, schema: str, wave: int = 64) -> DataFrame:
    """Rows of a paged service: ``fetch(page)`` gives rows as tuples; the first empty page ends it, whatever later pages hold.

    Pages are fetched in waves, each spread over tasks and written, and no wave follows one with an empty page. ``fetch`` is the
    only thing that knows the service, so tests pass a plain function.
    """
    ship(spark)
    arrow = spark.createDataFrame([], f"_page long, {schema}").toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                rows = [(page, *r) for r in fetch(page)] or [(-1 - page, *[None] * (len(arrow) - 1))]  # an empty page leaves its mark
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    out = spark.createDataFrame([], f"_page long, {schema}")
    for at in range(0, pages, wave):
        some = min(wave, pages - at)
        got = written(spark.range(at, at + some, 1, some).mapInArrow(run, f"_page long, {schema}"))
        end = got.where("_page < 0").agg(F.min(-1 - F.col("_page"))).first()[0]
        out = out.unionByName(got.where("_page >= 0" + ("" if end is None else f" and _page < {end}")))
        if end is not None:
            break
    return out.drop("_page")

"""Item/result file readers and writers.

Readers are plain ``spark.read`` calls with the options that keep quoted
multi-line TSV/CSV fields intact; many result files are read as one
DataFrame with the file name as a column (R2), so scoring all runs is a
single job grouped by run. Writers append or write new folders; nothing
is collected to the driver.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.sources import shared

# pandas' default NA words, which its CSV reader turns into NaN.
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
            "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Own names of the prompting modes, as used in result file names.
MODE_NAMES = ("direct", "stepwise", "chain", "ready_chain", "multi_turn", "exchange")

ITEM_COLUMNS = ("prompt", "image")
_CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def null_na_words(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn pandas NA words in string columns into nulls (R1 null model)."""
    targets = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    words = list(NA_WORDS)
    return df.select(*[
        F.when(F.col(c).isin(words), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c)
        if c in targets else F.col(c) for c in df.columns])


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               na_words: bool = True) -> DataFrame:
    """Load an item/result table by suffix: .tsv .csv .json .jsonl .parquet."""
    low = path.lower().rstrip("/")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if low.endswith(".tsv") or low.endswith(".csv"):
        sep = "\t" if low.endswith(".tsv") else ","
        df = reader.options(**_CSV_OPTS, sep=sep).csv(path)
        return null_na_words(df) if na_words else df
    if low.endswith(".jsonl"):
        return reader.json(path)
    if low.endswith(".json"):
        if column_oriented(spark, path):
            return columns_to_rows(spark, path, schema)
        return reader.option("multiLine", "true").json(path)
    if low.endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def column_oriented(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds one object of columns, each an object by row index."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    cells = doc.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select(
        "key", F.schema_of_variant("value").alias("kind"))
    # a list has elements without a key
    odd = F.col("key").isNull() | ~F.col("kind").rlike("^OBJECT<(`?[0-9]+`?: .*)?>$")
    return cells.agg(F.count("*") > 0, F.coalesce(F.bool_or(odd), F.lit(False))).first() == (True, False)


def columns_to_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """``{"col": {"0": v, ...}, ...}`` JSON -> one row per index, by index.

    The document is read as a VARIANT and exploded, so no schema is inferred from
    its cells. With a ``schema`` the rows have its columns and types (null where
    a cell is absent, or not of the type) and nothing is collected; without one the columns are
    the document's, as text, and their names are read first. One JSON document
    cannot be split, so its parse is one task; what follows is distributed.
    """
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))
    columns = doc.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select(
        F.col("key").alias("col"), F.col("value").alias("column"))
    cells = columns.lateralJoin(spark.tvf.variant_explode(F.col("column").outer())).select(
        "col", F.col("key").cast("long").alias("row_index"), F.col("value").alias("cell"))
    if schema is None:
        fields = [T.StructField(r[0], T.StringType()) for r in columns.select("col").distinct().orderBy("col").collect()]
    else:
        given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        fields = [f for f in given.fields if f.name != "row_index"]
    return cells.where(F.col("col").isin(*(f.name for f in fields))).groupBy("row_index").agg(*(
        F.max(F.when(F.col("col") == f.name, F.try_variant_get("cell", "$", f.dataType.simpleString()))).alias(f.name)
        for f in fields))


def positioned(spark: SparkSession, path: str, out: str = "position") -> DataFrame:
    """P2 + P4: a stored Parquet table with each row's 0-based place in it, in the order
    of its files' names and of the rows in them.

    A row's place in its file comes from the reader, and the number of rows before a
    file from the counts of the files, so nothing is sorted, shuffled or written: the order
    is the one that was fixed when the table was written.
    """
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))   # one row a file
    return placed.join(offsets, "_file").select(*rows.columns, (F.col("_offset") + F.col("_row")).alias(out))


def scan_results(spark: SparkSession, folder: str, schema: T.StructType | str,
                 glob: str = "*.tsv", sep: str = "\t") -> DataFrame:
    """R2: every result file of a folder in one DataFrame, ``file_name`` per row.

    The schema is declared by position, since the response column is
    named after the model and differs between files.
    """
    df = (spark.read.schema(schema).options(**_CSV_OPTS, sep=sep, pathGlobFilter=glob)
          .csv(folder))
    return null_na_words(df.withColumn("file_name", F.col("_metadata.file_name")))


def _first_record(sep: str, open_file=shared.file_system):
    """A function of batches of paths that reads the first record of each file.
    It is shipped by value, so it imports what it uses."""

    def run(batches):
        import csv
        import io

        import pyarrow as pa

        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                store, place = open_file(path)
                with store.open_input_file(place) as file:
                    size, take, record = file.size(), 1 << 14, []
                    while True:
                        text = file.read_at(min(take, size), 0).decode("utf-8-sig", "ignore")
                        rows = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
                        record = next(rows, [])
                        # whole if something follows it, or nothing is left to read
                        if next(rows, None) is not None or take >= size:
                            break
                        take *= 4
                found.append(record)
            yield pa.RecordBatch.from_arrays(
                [batch["file_path"], pa.array(found, pa.list_(pa.string()))], ["file_path", "header"])

    return run


def file_headers(spark: SparkSession, folder: str, glob: str = "*.tsv", sep: str = "\t") -> DataFrame:
    """R2: file_path and header of every file, read by tasks: the first record of
    each file and no more."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .load(folder).select("path", F.col("_metadata.file_path").alias("file_path")))
    return files.mapInArrow(_first_record(sep), "file_path string, header array<string>")


def scan_runs(spark: SparkSession, folder: str, columns: Sequence[str], glob: str = "*.tsv",
              sep: str = "\t") -> DataFrame:
    """R2 + R7: result files by their own headers, ``columns`` and ``response`` as text.

    Files may order their columns differently and name the response column
    after the model. Tasks read the headers, one job checks them, and all files
    are one scan by position, whose values are taken by name from the header of
    their file: any number of files and headers needs the same number of jobs.
    """
    headers = shared.stored(file_headers(spark, folder, glob, sep), "headers")
    named = F.filter("header", lambda c: F.contains(c, F.lit("response")) & ~F.contains(c, F.lit("intermediate")))
    width, bad, example, found = headers.agg(
        F.max(F.size("header")), F.count_if((F.size("header") > 0) & (F.size(named) != 1)),
        F.min(F.when((F.size("header") > 0) & (F.size(named) != 1), F.col("file_path"))), F.count("*")).first()
    if not found:
        raise ValueError(f"no result file in {folder}")
    if bad:
        raise ValueError(f"expected exactly one response column; {bad} files differ, such as {example}")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(width or 0, 1))])
    rows = (spark.read.schema(schema).options(**_CSV_OPTS, sep=sep, pathGlobFilter=glob, recursiveFileLookup="true")
            .csv(folder).withColumns({"file_path": F.col("_metadata.file_path"), "file_name": F.col("_metadata.file_name")}))
    place = headers.select("file_path", *(F.array_position("header", F.lit(c)).alias(f"p{i}") for i, c in enumerate(columns)),
                           F.array_position("header", F.element_at(named, 1)).alias("pr"))
    values = F.array(*(F.col(f.name) for f in schema.fields))
    out = rows.join(place, "file_path").select(
        *(F.get(values, F.col(f"p{i}").cast("int") - 1).alias(c) for i, c in enumerate(columns)),
        F.get(values, F.col("pr").cast("int") - 1).alias("response"), "file_path", "file_name")
    return null_na_words(out, [*columns, "response"])


def run_metadata(df: DataFrame, file_col: str = "file_name",
                 modes: Sequence[str] = MODE_NAMES) -> DataFrame:
    """``{model}_{bench}_{mode}_result.tsv`` -> model, bench, mode, stems.

    The mode is matched first from the known list at the end, so model
    names may contain '_'.
    """
    alt = "|".join(modes)
    f = F.col(file_col)
    rest = F.regexp_replace(f, f"_({alt})_result\\.tsv$", "")
    return df.select(
        "*",
        F.regexp_extract(f, f"_({alt})_result\\.tsv$", 1).alias("mode"),
        F.regexp_extract(rest, "^(.*)_[^_]*$", 1).alias("model"),
        F.regexp_extract(rest, "_([^_]*)$", 1).alias("bench"),
        F.regexp_extract(f, "^(.*)\\.[^.]*$", 1).alias("run_stem"),
        F.substring_index(f, ".", 1).alias("bench_stem"),
    )


def result_file_name(model: str, bench_path: str, mode: str) -> str:
    """R3 (forward): the result file name for a run."""
    bench = os.path.basename(bench_path).split(".")[0]
    return f"{model}_{bench}_{mode}_result.tsv"


def load_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Image files -> (path, base64 text without line breaks)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return df.select("path", F.regexp_replace(F.base64("content"), "[\\r\\n]", "").alias("image"))


def check_items(df: DataFrame, required: Sequence[str] = ITEM_COLUMNS) -> DataFrame:
    """The item table must have ``prompt`` and ``image`` (checked at plan time)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"item table lacks columns {missing}")
    return df


def find_response_column(columns: Sequence[str]) -> str:
    """The one column named like a response but not an intermediate one."""
    hits = [c for c in columns if "response" in c and "intermediate" not in c]
    if len(hits) != 1:
        raise ValueError(f"expected exactly one response column, found {hits}")
    return hits[0]


def list_text(c: str | Column) -> Column:
    """List column -> JSON text for TSV storage."""
    return F.to_json(F.col(c) if isinstance(c, str) else c)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Append a batch of rows (header written by each new TSV part file)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "tsv":
        w.options(header="true", sep="\t", quote='"', escape='"').csv(path)
    else:
        w.format(fmt).save(path)


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write an enriched table to a new folder (fails if it exists)."""
    w = df.write.mode("errorifexists")
    if fmt == "tsv":
        w.options(header="true", sep="\t", quote='"', escape='"').csv(path)
    else:
        w.format(fmt).save(path)


def write_sheet(wide: DataFrame, path: str, fmt: str = "csv") -> None:
    """The score sheet as CSV/JSON/Parquet (small: one row per run)."""
    w = wide.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


# Ship the functions of this module and of the file helper by value: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(shared)

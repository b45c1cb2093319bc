"""Files in and out: CSV seeds, text trees, markdown tables, hash manifests, catalog tables, printing."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def generated(spark: SparkSession, generate: Callable[..., dict[str, DataFrame | pd.DataFrame]], **how) -> dict[str, DataFrame]:
    """The tables a generator function makes, by name; frames of pandas come in as well."""
    return {name: frame if isinstance(frame, DataFrame) else spark.createDataFrame(frame) for name, frame in generate(spark, **how).items()}


def invoices(spark: SparkSession, n_customers: int = 400, seed: int = 42) -> dict[str, DataFrame]:
    """A generator: customers and their invoices, twelve a customer, the same for the same seed; made on the executors."""
    mix = lambda c, salt: (c * 7919 + salt * 104729 + seed) % 1000003
    one = F.col("id")
    customers = spark.range(1, n_customers + 1).select(one.alias("customer_id"), F.format_string("customer_%05d", one).alias("name"), F.element_at(F.array(*[F.lit(x) for x in ("free", "light", "standard")]), (mix(one, 1) % 3 + 1).cast("int")).alias("plan"))
    bills = spark.range(n_customers * 12).select((one + 1).alias("invoice_id"), (F.floor(one / 12) + 1).alias("customer_id"), F.add_months(F.lit("2024-01-01").cast("date"), (one % 12).cast("int")).alias("invoice_month"), (mix(one + 1, 2) % 100000).alias("amount"), F.when(mix(one + 1, 3) % 10 == 0, "open").otherwise("paid").alias("status"))
    return {"customers": customers, "invoices": bills}


@contextmanager
def opened(spark: SparkSession, name: str) -> Iterator[str]:
    """A database opened, made where it isn't there, as the current one; closing it brings back the one before."""
    before = spark.catalog.currentDatabase()
    create_schema(spark, name)
    spark.catalog.setCurrentDatabase(name)
    try:
        yield name
    finally:
        spark.catalog.setCurrentDatabase(before)


def load(spark: SparkSession, tables: dict[str, DataFrame], schema: str, place: Callable[[str], str]) -> list[str]:
    """Every table registered, created or replaced under the schema by its upper-case name, and unregistered; their full names.

    The schema is made where it isn't there; a table that fails is unregistered as well.
    """
    create_schema(spark, schema)
    names = []
    for name, df in tables.items():
        register(df, "df_in")
        try:
            create_table_as(spark.table("df_in"), schema, name, place(name))
        finally:
            unregister(spark, "df_in")
        names.append(f"`{schema}`.`{name.upper()}`")
    return names


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def unregister(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`" + (f" LOCATION '{location}'" if location else ""))


def create_table_as(df: DataFrame, schema: str, name: str, location: str) -> DataFrame:
    """Create or replace a table from a frame, its files under ``location``; names hold in any case."""
    df.write.mode("overwrite").format("parquet").option("path", location).saveAsTable(f"`{schema}`.`{name.upper()}`")
    return df.sparkSession.table(f"`{schema}`.`{name.upper()}`")


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with header and a declared schema; an empty field is null, `True`/`False` are booleans."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)


def text_tree(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """(path, text) of every file under a folder that matches, in the order of paths."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("text")).orderBy("path")


def write_tree(files: DataFrame, path: str) -> None:
    """Rewritten texts go to a new folder: files are never changed in place."""
    files.write.mode("errorifexists").parquet(path)


def markdown_rows(lines: DataFrame, line: str, columns: list[str]) -> DataFrame:
    """Cells of markdown table rows, by name; header, rule and text lines are left out.

    A row begins and ends with a pipe and has one cell a column; rows with another number of cells
    come out with ``cells`` telling it and null values, so that they can be reported.
    """
    trimmed = F.trim(F.col(line))
    cells = F.transform(F.split(F.regexp_replace(trimmed, r"^\||\|$", ""), r"\|"), lambda c: F.nullif(F.trim(c), F.lit("")))
    rows = lines.where(trimmed.startswith("|") & ~trimmed.rlike(r"^[|\s:-]+$")).select(cells.alias("c"))
    header = F.lower(F.coalesce(F.element_at("c", 1), F.lit(""))) == columns[0].lower()
    ok = F.size("c") == len(columns)
    return rows.where(~header).select(*[F.when(ok, F.get("c", F.lit(i))).alias(n) for i, n in enumerate(columns)], F.size("c").alias("cells"))


def sha256_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, expected) from lines of `digest  name`."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 2).alias("file"), F.lower(F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$", 1)).alias("expected")).where(F.col("file") != "")


def verify_manifest(spark: SparkSession, folder: str, manifest: DataFrame, name: str = r"([^/]+)$") -> DataFrame:
    """(file, expected, actual, ok) of every file that the manifest names; a missing file has no actual digest.

    ``name`` is the pattern whose group tells a file's name from its path, its last part unless given.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    actual = files.select(F.regexp_extract("path", name, 1).alias("file"), F.sha2("content", 256).alias("actual"))
    return manifest.join(actual, "file", "left").select("file", "expected", "actual", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(no, line) of a text table: a header (0), a rule (1) and the rows by ``order``, columns as wide as their widest value.

    For results to be read, which are small: rows are numbered in one partition. A null is an empty cell.
    """
    rows = df.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("no"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"c_{i}") for i, c in enumerate(df.columns)])
    head = df.sparkSession.createDataFrame([(0, *df.columns), (1, *["-"] * len(df.columns))], rows.schema)
    every = Window.partitionBy(F.lit(0))
    pad = [F.rpad(F.col(f"c_{i}"), F.max(F.length(f"c_{i}")).over(every), F.when(F.col("no") == 1, "-").otherwise(" ")) for i in range(len(df.columns))]
    return head.unionByName(rows).select("no", F.concat_ws("  ", *pad).alias("line"))


def print_table(df: DataFrame, order: list[str]) -> None:
    """A small result as a text table."""
    for r in table_lines(df, order).orderBy("no").collect():
        print(r.line)


def check_manifest(manifest: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, status) of everything that a manifest of (key, expected) names, held against (key, actual).

    ``ok``, ``changed``, or ``missing`` where there is nothing to hold against; what the manifest does not name is ``unlisted``.
    """
    both = manifest.select(key, "expected").join(actual.select(key, "actual"), key, "full")
    status = F.when(F.col("expected").isNull(), "unlisted").when(F.col("actual").isNull(), "missing").when(F.lower("expected") == F.lower("actual"), "ok").otherwise("changed")
    return both.select(key, "expected", "actual", status.alias("status"))

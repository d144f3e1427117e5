"""Per-slot tables: delimiter detection, mixed CSV/TSV folders, file-name metadata, Parquet scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD_CHARS = 65536
EXTENSIONS = ("csv", "tsv", "tab")


def list_files(spark: SparkSession, path: str, pattern: str = "*", max_files: int | None = None) -> DataFrame:
    """Sorted ``(path, name, ext)`` of delimited files below ``path``; file contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
        .load(path).select("path")
        .withColumn("name", F.element_at(F.split("path", "/"), -1))
        .withColumn("ext", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
        .where(F.col("ext").isin(*EXTENSIONS))
        .orderBy("path")
    )
    return listed.limit(max_files) if max_files else listed


def _read_heads(batches):
    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        heads = []
        for uri in batch["path"]:
            location = uri if not uri.startswith("file:") else "file://" + uri.split(":", 1)[1].replace("///", "/")
            filesystem, inner = fs.FileSystem.from_uri(location)
            with filesystem.open_input_stream(inner) as stream:
                heads.append(stream.read(HEAD_CHARS * 4).decode("utf-8", errors="ignore")[:HEAD_CHARS])
        yield pd.DataFrame({"path": batch["path"], "name": batch["name"], "ext": batch["ext"], "head": heads})


def _occurrences(text: str, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(F.col(text), F.lit(mark)))


def delimiter_of(head: str, ext: str) -> Column:
    """Most frequent of tab, comma, semicolon (ties in that order); without any, the extension decides."""
    tabs, commas, semis = (_occurrences(head, mark) for mark in ("\t", ",", ";"))
    by_ext = F.when(F.col(ext).isin("tsv", "tab"), "\t").otherwise(",")
    return (
        F.when((tabs > 0) & (tabs >= commas) & (tabs >= semis), "\t")
        .when((commas > 0) & (commas >= semis), ",")
        .when(semis > 0, ";")
        .otherwise(by_ext)
    )


def detect_delimiters(files: DataFrame, tasks: int = 64) -> DataFrame:
    """Add ``sep`` and ``header``; every task opens its files and reads 64 KiB of each."""
    heads = files.repartition(tasks, "path").mapInPandas(
        _read_heads, "path string, name string, ext string, head string"
    )
    first = F.regexp_replace(F.substring_index("head", "\n", 1), "\r$", "")
    return heads.select("path", "name", "ext", delimiter_of("head", "ext").alias("sep"), first.alias("header"))


def scan_slot_files(spark: SparkSession, path: str, pattern: str = "*", max_files: int | None = None,
                    rename=None) -> DataFrame:
    """Read a folder of mixed delimited files as one all-string frame.

    Files with equal delimiter and header are read by one scan; ``rename`` (frame to frame) runs on each scan
    before the union by name. Only paths and headers reach the driver.
    """
    # File listing metadata only; Spark keeps the same listing on the driver itself.
    files = detect_delimiters(list_files(spark, path, pattern, max_files)).select("path", "sep", "header").collect()
    groups: dict[tuple[str, str], list[str]] = {}
    for row in sorted(files, key=lambda r: r["path"]):
        groups.setdefault((row["sep"], row["header"]), []).append(row["path"])
    frames = []
    for (sep, header), paths in groups.items():
        names = [name.strip().strip('"') for name in header.split(sep)]
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        frame = (
            spark.read.schema(schema).option("header", "true").option("sep", sep).option("enforceSchema", "true")
            .csv(paths).withColumn("source_file", F.col("_metadata.file_name"))
        )
        frames.append(rename(frame) if rename else frame)
    if not frames:
        raise FileNotFoundError(f"no delimited files under {path}")
    return diagonal_union(frames)


def diagonal_union(frames) -> DataFrame:
    """Union by name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_name_metadata(df: DataFrame, name: str = "source_file", window: str = "window",
                       target: str = "target_bler", keep: bool = False) -> DataFrame:
    """Window and target BLER from names like ``…BLERw2000Tbler0.05_….csv`` (any case).

    With ``keep``, values that a text column of the frame has already win over those of the name.
    """
    window_text = F.regexp_extract(name, r"(?i)BLERw(\d+)", 1)
    target_text = F.rtrim(F.regexp_extract(name, r"(?i)Tbler([0-9.]+)", 1), F.lit("."))
    found = {window: window_text.try_cast("int"), target: target_text.try_cast("double")}
    if keep:
        own = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
        found = {c: F.coalesce(own(c), v.cast("string")) if c in df.columns else v.cast("string") for c, v in found.items()}
    return df.withColumns(found)


def scenario_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    """Target, window, altitude and seed from folder names like ``TB0.01_W2000_ALT600km_S001``."""
    pattern = r"TB([0-9.eE+-]+)_W(\d+)_ALT(\d+)km_S(\d+)"
    return df.withColumns({
        "target_bler": F.regexp_extract(path, pattern, 1).try_cast("double"),
        "bler_window": F.regexp_extract(path, pattern, 2).try_cast("int"),
        "altitude_km": F.regexp_extract(path, pattern, 3).try_cast("int"),
        "seed": F.regexp_extract(path, pattern, 4).try_cast("int"),
    })


def scan_features(spark: SparkSession, path: str, columns, not_null=(), head: int | None = None) -> DataFrame:
    """Parquet scan that reads only ``columns`` and pushes the not-null filters; ``head`` caps the rows."""
    df = spark.read.parquet(path)
    df = df.select([c for c in columns if c in df.columns])
    for name in not_null:
        df = df.where(F.col(name).isNotNull())
    return df.limit(head) if head else df

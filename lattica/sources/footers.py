"""Profiles of Parquet columns from the footers of the files, without reading their values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_READERS, _PUSHED = "spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown"


@contextmanager
def pushed_aggregates(spark: SparkSession) -> Iterator[None]:
    """Within, counts and ranges without a filter come from footers: such plans must be made and run in here."""
    before = {key: spark.conf.get(key) for key in (_READERS, _PUSHED)}
    spark.conf.set(_READERS, ",".join(x for x in before[_READERS].split(",") if x != "parquet"))
    spark.conf.set(_PUSHED, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def aggregated(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    each = [x for k, c in enumerate(columns) for x in (F.count(c).alias(f"n{k}"), F.min(c).alias(f"low{k}"), F.max(c).alias(f"high{k}"))]
    return spark.read.parquet(*paths).agg(F.count("*").alias("rows"), *each)


def footer_profile(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, least and largest of number columns: column, rows, missing, least, largest (doubles).

    Files without statistics of a column (also those that hold only nulls or a NaN there) can't be answered from footers;
    then the columns are scanned. A table without rows has no least and largest.
    """
    try:
        with pushed_aggregates(spark):
            row = aggregated(spark, paths, columns).first()
    except (PySparkException, Py4JJavaError) as e:
        if "aggregatePushdown" not in str(e):
            raise
        row = aggregated(spark, paths, columns).first()

    def number(x):
        return None if x is None else float(x)

    # without any row group the counts are null
    total = row["rows"] or 0
    rows = [(c, total, total - (row[f"n{k}"] or 0), number(row[f"low{k}"]), number(row[f"high{k}"])) for k, c in enumerate(columns)]
    return spark.createDataFrame(rows, "column string, rows long, missing long, least double, largest double")


#: Schemes that Arrow opens by itself in a task, reading a file's footer only; files of other stores are handed over whole by Spark.
OPENED = ("file", "s3", "gs", "hdfs")


def _groups(meta, schema, columns: Sequence[str]) -> list[tuple]:
    """(row group, its rows, its bytes, (column, nulls, least, largest) of the wanted columns as text, NULL where there are no statistics) of one footer."""
    names = [meta.schema.column(k).path for k in range(meta.num_columns)]
    out = []
    for g in range(meta.num_row_groups):
        group, ranges = meta.row_group(g), []
        for c in columns:
            stats = group.column(names.index(c)).statistics if c in names else None
            has = stats is not None and stats.has_min_max
            ranges.append({"column": c, "nulls": stats.null_count if stats is not None and stats.has_null_count else None, "least": str(stats.min) if has else None, "largest": str(stats.max) if has else None})
        out.append((g, group.num_rows, group.total_byte_size, ranges))
    return out


def row_groups(spark: SparkSession, path: str, columns: Sequence[str] = (), with_hash: bool = False) -> DataFrame:
    """Per Parquet file and row group: path, bytes, sha256 (if asked for), rows, columns (names), schema (text), group, group_rows, group_bytes, ranges (column, nulls, least, largest as text).

    Footers are read in the tasks, a file by a task: only the footer where Arrow can open the store; else, or with a hash, the whole file, which
    then has to fit in a row (2 GB). A file without row groups has one row with a null group. A nested column goes by its dotted path; one that a file doesn't have has no range.
    """
    import hashlib

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    schemes = {r["scheme"] for r in files.select(F.substring_index("path", ":", 1).alias("scheme")).distinct().collect()}
    whole = with_hash or not schemes <= set(OPENED)
    wanted = list(columns)

    def read(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("column", pa.string()), ("nulls", pa.int64()), ("least", pa.string()), ("largest", pa.string())]))]
        for batch in batches:
            for k in range(batch.num_rows):
                name, size = batch.column("path")[k].as_py(), batch.column("length")[k].as_py()
                if whole:
                    raw = batch.column("content")[k].as_buffer()
                    source, digest = pa.BufferReader(raw), hashlib.sha256(raw).hexdigest() if with_hash else None
                else:
                    store, inner = fs.FileSystem.from_uri(name)
                    source, digest = store.open_input_file(inner), None
                with pq.ParquetFile(source) as f:
                    about = (name, size, digest, f.metadata.num_rows, f.schema_arrow.names, str(f.schema_arrow.remove_metadata()))
                    rows = [(*about, *g) for g in _groups(f.metadata, f.schema_arrow, wanted)] or [(*about, None, None, None, [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "bytes", "sha256", "rows", "columns", "schema", "group", "group_rows", "group_bytes", "ranges"])

    return files.select("path", "length", *(["content"] if whole else [])).mapInArrow(read, "path string, bytes long, sha256 string, rows long, columns array<string>, schema string, group int, group_rows long, group_bytes long, ranges array<struct<column:string,nulls:long,least:string,largest:string>>")

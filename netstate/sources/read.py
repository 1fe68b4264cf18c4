"""Reading state tables: versions, raw plus compacted data, time blocks, views.

Layout under ``root``: ``<table>/sqvers=/namespace=/hostname=`` for appended
changes and ``coalesced/<table>/sqvers=/namespace=/block_start=`` for compacted
blocks.  All pruning is on those partition columns.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from netstate.catalog import table_names, table_spec
from netstate.functions import timefn
from netstate.operators import filters, views
from netstate.sources import migrate

COMPACTED = "coalesced"
PARTITION_TYPES = {
    "sqvers": T.StringType(), "namespace": T.StringType(), "hostname": T.StringType(),
    "service": T.StringType(), "block_start": T.LongType(),
}


def table_path(root: str, table: str, compacted: bool = False) -> str:
    stored = table_spec(table).physical or table
    return f"{root.rstrip('/')}/{COMPACTED}/{stored}" if compacted else (
        f"{root.rstrip('/')}/{stored}")


def _list_dirs(spark: SparkSession, path: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    return [str(s.getPath().getName()) for s in fs.listStatus(hadoop) if s.isDirectory()]


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Schema versions present, newest last."""
    found = [d.split("=", 1)[1] for d in _list_dirs(spark, path) if d.startswith("sqvers=")]
    return sorted(found, key=lambda v: [int(p) for p in re.findall(r"\d+", v)])


def _partition_schema(schema: T.StructType) -> T.StructType:
    """Partition columns keep their text: host '0012' must not become 12."""
    return T.StructType([
        T.StructField(f.name, PARTITION_TYPES.get(f.name, f.dataType)) for f in schema])


def read_version(spark: SparkSession, path: str, table: str, version: str,
                 ignore_corrupt: bool = False) -> DataFrame:
    """One version directory with its own schema, partition columns discovered."""
    spec = table_spec(table)
    reader = spark.read.option("basePath", path).option(
        "ignoreCorruptFiles", str(ignore_corrupt).lower())
    where = f"{path}/sqvers={version}"
    if version == spec.version:
        schema = spec.schema
        if COMPACTED in path.split("/")[-2:]:
            schema = T.StructType([*schema.fields, T.StructField("block_start", T.LongType())])
        return reader.schema(schema).parquet(where)
    found = _partition_schema(reader.parquet(where).schema)
    return reader.schema(found).parquet(where)


def read_versions(spark: SparkSession, path: str, table: str, only: str | None = None,
                  ignore_corrupt: bool = False) -> DataFrame | None:
    """All versions, older ones migrated, in one frame; None where nothing is stored."""
    parts = []
    for v in versions(spark, path):
        if only and v != only:
            continue
        df = read_version(spark, path, table, v, ignore_corrupt)
        if v != table_spec(table).version:
            df = migrate.migrate(df, table, v, keep=["block_start"])
        parts.append(df)
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def with_sqvers(df: DataFrame, found: list[str]) -> DataFrame:
    """Stamp every row with the highest version read."""
    return df.withColumn("sqvers", F.lit(found[-1] if found else None).cast("string"))


def block_condition(
    blocks: list[tuple[str, int]], period_ms: int, start: int | None, end: int | None,
    view: str | None,
) -> Column | None:
    """Which (namespace, block) a time window needs; None means all of them.

    Every compacted block holds the whole state of its namespace, so the last
    block answers 'latest' and the last two up to ``end`` answer 'as of end'.
    """
    if start is None and end is None and view == "all":
        return None
    per_ns: dict[str, list[int]] = {}
    for ns, b in sorted(blocks):
        per_ns.setdefault(ns, []).append(b)
    wanted: dict[str, list[int]] = {}
    for ns, bs in per_ns.items():
        if start is None and end is None:
            wanted[ns] = bs[-1:]
            continue
        keep = [b for b in bs if (start is None or b + period_ms > start)
                and (end is None or b <= end)]
        wanted[ns] = keep[-2:] if start is None and view != "all" else keep
    terms = [
        (F.col("namespace") == ns) & F.col("block_start").isin(bs)
        for ns, bs in wanted.items() if bs]
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def list_blocks(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(namespace, block_start) directories of a compacted table; no file is listed."""
    found = set()
    for version in _list_dirs(spark, path):
        if not version.startswith("sqvers="):
            continue
        for space in _list_dirs(spark, f"{path}/{version}"):
            if not space.startswith("namespace="):
                continue
            name = unquote(space.split("=", 1)[1])
            found |= {(name, int(b.split("=", 1)[1])) for b in _list_dirs(
                spark, f"{path}/{version}/{space}") if b.startswith("block_start=")}
    return sorted(found)


def prune_blocks(df: DataFrame, blocks: list[tuple[str, int]], period_ms: int,
                 start: int | None = None, end: int | None = None,
                 view: str | None = None) -> DataFrame:
    """Keep the blocks a time window needs, as a filter on partition columns."""
    cond = block_condition(blocks, period_ms, start, end, view)
    return df if cond is None else df.where(cond)


def union_raw_and_compacted(raw: DataFrame | None, compacted: DataFrame | None) -> DataFrame:
    frames = [f for f in (raw, compacted) if f is not None]
    if not frames:
        raise FileNotFoundError("neither raw nor compacted data")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_log(
    spark: SparkSession, root: str, table: str, start: int | None = None,
    end: int | None = None, view: str | None = None, period: str = "1h",
    version: str | None = None, ignore_corrupt: bool = False,
) -> DataFrame:
    """The change log of a table: raw and needed compacted blocks, not yet a view.

    Compaction takes away the raw files it has consumed, so raw rows are those
    since the newest block and late ones.
    """
    raw = read_versions(spark, table_path(root, table), table, version, ignore_corrupt)
    path = table_path(root, table, compacted=True)
    compacted = read_versions(spark, path, table, version, ignore_corrupt)
    if compacted is not None:
        compacted = prune_blocks(
            compacted, list_blocks(spark, path), timefn.period_ms(period), start, end,
            view).drop("block_start")
    if raw is None and compacted is None:
        return spark.createDataFrame([], table_spec(table).schema)
    return union_raw_and_compacted(raw, compacted)


def read_table(
    spark: SparkSession, root: str, table: str, view: str | None = None, start=None, end=None,
    columns=("*",), stage: str = "post", tz: str = "UTC", only_active: bool = True,
    period: str = "1h", **fields,
) -> DataFrame:
    """Scan, filter, merge, dedup and view in one call.

    Filters on keys go before the view.  Others go after it unless
    ``stage='pre'``, which asks for the last row that satisfied them.
    """
    start, end = timefn.to_epoch_ms(start, tz), timefn.to_epoch_ms(end, tz)
    df = read_log(spark, root, table, start, end, view, period)
    return view_table(df, table, view, start, end, columns, stage, only_active, **fields)


def view_table(
    df: DataFrame, table: str, view=None, start=None, end=None, columns=("*",),
    stage: str = "post", only_active: bool = True, **fields,
) -> DataFrame:
    """``read_table`` over a log that is already a DataFrame."""
    spec = table_spec(table)
    pre = {k: v for k, v in fields.items() if k in spec.keys or stage == "pre"}
    post = {k: v for k, v in fields.items() if k not in pre}
    if table == "routes":
        df = filters.drop_kernel_unreachable(df)
    df = filters.apply_filter(df, filters.table_filter(table, **pre))
    df = views.apply_view(df, spec.keys, view, start, end, only_active)
    df = filters.apply_filter(df, filters.filter_expr(df.schema, **post))
    if list(columns) != ["*"]:
        df = df.select(*columns)
    return df


def stored_tables(spark: SparkSession, root: str) -> list[str]:
    """Catalog tables that have data under the root."""
    found = {*_list_dirs(spark, root), *_list_dirs(spark, f"{root.rstrip('/')}/{COMPACTED}")}
    return [t for t in table_names(stored_only=True) if t in found]


class Store:
    """Where the plans get their tables from: a Parquet root or given frames."""

    def __init__(self, spark: SparkSession, root: str | None = None,
                 frames: dict[str, DataFrame] | None = None, period: str = "1h"):
        self.spark, self.root, self.frames, self.period = spark, root, frames or {}, period

    def tables(self) -> list[str]:
        if self.frames:
            return sorted(self.frames)
        return stored_tables(self.spark, self.root)

    def log(self, table: str, start=None, end=None, view=None) -> DataFrame:
        stored = table_spec(table).physical or table
        if stored in self.frames:
            return self.frames[stored]
        if self.root is None:
            return self.spark.createDataFrame([], table_spec(stored).schema)
        return read_log(self.spark, self.root, stored, start, end, view, self.period)


def audit_parquet(spark: SparkSession, root: str) -> DataFrame:
    """Files that are not readable Parquet: (path, length, problem).

    Only the first and last bytes of each file decide; they are read by the
    tasks, not by the driver.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", "true").load(root).select("path", "length")
    )
    conf = spark._jsc.hadoopConfiguration()
    local = str(conf.get("fs.defaultFS", "file:///")).startswith("file")

    def check(batches):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for pdf in batches:
            problems = []
            for path in pdf["path"]:
                try:
                    if path.startswith("file:"):
                        pq.ParquetFile(path.split("file:", 1)[1]).metadata
                    else:
                        fs, inner = pafs.FileSystem.from_uri(path)
                        pq.ParquetFile(inner, filesystem=fs).metadata
                    problems.append(None)
                except Exception as exc:
                    problems.append(str(exc).splitlines()[0][:200])
            yield pdf.assign(problem=problems)

    spread = files.repartition(max(spark.sparkContext.defaultParallelism, 1)) if local else files
    return spread.mapInPandas(check, "path string, length bigint, problem string").where(
        "problem is not null")


def quarantine(spark: SparkSession, root: str, bad: DataFrame) -> int:
    """Move bad files under ``_broken/`` of the root; returns how many moved."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.resolvePath(base).toString().rstrip("/")
    moved = 0
    for row in bad.select("path").toLocalIterator():
        relative = row.path.split(full.split(":", 1)[-1].replace("//", "/"), 1)[-1].lstrip("/")
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{full}/_broken/{relative}")
        fs.mkdirs(target.getParent())
        moved += bool(fs.rename(spark._jvm.org.apache.hadoop.fs.Path(row.path), target))
    return moved


def readable(df: DataFrame) -> bool:
    """Whether the plan of a read can be analysed at all."""
    try:
        return bool(df.schema)
    except AnalysisException:
        return False

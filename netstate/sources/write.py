"""Writing state tables, exports and compaction statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from netstate.catalog import default_value, table_spec
from netstate.sources.read import table_path

# Fixed value: compression of every stored file.
COMPRESSION = "zstd"


def typed_default(dtype: T.DataType) -> Column:
    value = default_value(dtype)
    return F.array().cast(dtype) if value == [] else F.lit(value).cast(dtype)


def cast_or_default(c: Column, dtype: T.DataType, default: Column | None = None) -> Column:
    """Cast; what cannot be cast becomes the default, element by element in lists."""
    default = typed_default(dtype) if default is None else default
    if isinstance(dtype, T.ArrayType):
        item = dtype.elementType
        return F.coalesce(
            F.transform(c, lambda x: F.coalesce(
                x.try_cast(item.simpleString()), typed_default(item))), default)
    return F.coalesce(c.try_cast(dtype.simpleString()), default)


def conform_for_write(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Schema columns in schema order; missing or uncastable values become defaults."""
    spec = table_spec(table)
    out = []
    for f in spec.schema.fields:
        special = (
            F.lit(spec.version) if f.name == "sqvers"
            else F.lit(True) if f.name == "active" else None)
        if f.name not in df.columns:
            value = special if special is not None else typed_default(f.dataType)
        else:
            source = F.col(f.name)
            is_list = isinstance(df.schema[f.name].dataType, T.ArrayType)
            if not is_list and isinstance(f.dataType, T.ArrayType):
                source = F.array(source)
            value = cast_or_default(source, f.dataType, special)
        out.append(value.alias(f.name))
    return df.select(*out, *keep)


def _partition_columns(table: str, compacted: bool) -> list[str]:
    if table == "sqCoalescer":
        return ["sqvers", "namespace"]
    if compacted:
        return ["sqvers", "namespace", "block_start"]
    return ["sqvers", "namespace", "hostname"]


def write_raw(df: DataFrame, root: str, table: str) -> str:
    """Append changes, one directory per version, namespace and host."""
    path = table_path(root, table)
    parts = _partition_columns(table, compacted=False)
    (conform_for_write(df, table).write.mode("append").partitionBy(*parts)
     .option("compression", COMPRESSION).parquet(path))
    return path


def write_compacted(df: DataFrame, root: str, table: str) -> str:
    """Append compacted blocks; ``block_start`` (epoch ms) is a partition column."""
    path = table_path(root, table, compacted=True)
    (conform_for_write(df, table, ("block_start",)).write.mode("append")
     .partitionBy(*_partition_columns(table, compacted=True))
     .option("compression", COMPRESSION).parquet(path))
    return path


def export(df: DataFrame, path: str, fmt: str = "json", summary: bool = False) -> None:
    """Result export; lists in CSV become JSON text; a summary is written column-oriented."""
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown export format: {fmt!r}")
    if summary:
        from netstate.operators.summary import transpose_summary

        df = transpose_summary(df)
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
        return
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_compaction_stats(spark: SparkSession, root: str, stats: list[dict]) -> str:
    """One row per compacted table and run."""
    spec = table_spec("sqCoalescer")
    rows = spark.createDataFrame(
        [[s.get(f.name) for f in spec.schema.fields] for s in stats], spec.schema)
    return write_raw(rows, root, "sqCoalescer")

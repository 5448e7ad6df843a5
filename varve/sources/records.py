"""Record lists wrapped in a JSON envelope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.shared import materialize, scratch_path
from varve.sources.envelopes import record_texts
from varve.sources.text import POSITION


def envelope(record: T.StructType) -> T.StructType:
    """Schema of ``{"result": {"records": [record, ...]}}``."""
    return T.StructType().add("result", T.StructType().add("records", T.ArrayType(record)))


def flat_columns(record: Column, schema: T.StructType, prefix: str = "") -> list[Column]:
    """Leaves of a nested record, named by their path joined with dots."""
    columns = []
    for field in schema.fields:
        value, name = record.getField(field.name), prefix + field.name
        if isinstance(field.dataType, T.StructType):
            columns += flat_columns(value, field.dataType, name + ".")
        else:
            columns.append(value.alias(name))
    return columns


def explode_records(df: DataFrame, position: Column | None = None) -> DataFrame:
    """One row per element of ``result.records``, nested objects flattened."""
    schema = df.select("result.records").schema["records"].dataType.elementType
    place = F.struct(position, F.col("pos")) if position is not None else None
    rows = df.select("*", F.posexplode("result.records").alias("pos", "record"))
    return rows.select(
        *flat_columns(F.col("record"), schema), *([place.alias(POSITION)] if place is not None else [])
    )


def read_records(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    multiline: bool = True,
    position: bool = False,
    mode: str = "FAILFAST",
) -> DataFrame:
    """Records of JSON files that each hold one envelope, or one per line if not ``multiline``.

    A file holding one envelope is read in splits, by many tasks. Without ``schema``, that of one
    record, Spark reads the data once more to infer it.
    An envelope that is no JSON, does not fit the schema or lists no records fails the job, or is
    left out if ``mode`` is DROPMALFORMED; as the whole file decides, it is then read by one task.
    """
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(f"mode is FAILFAST or DROPMALFORMED, not {mode!r}")
    if multiline and mode == "FAILFAST":
        return _read_in_splits(spark, path, schema, position)
    reader = spark.read.option("multiLine", multiline).option("mode", mode)
    if schema is not None:
        reader = reader.schema(envelope(schema))
    read = reader.json(path if isinstance(path, str) else list(path))
    if mode == "FAILFAST":
        listed, missing = F.col("result.records"), F.raise_error(F.lit("an envelope without records"))
        kind = read.select(listed).schema[0].dataType
        read = read.withColumn("result", F.struct(F.coalesce(listed, missing.cast(kind)).alias("records")))
    if not position:
        return explode_records(read)
    placed = read.select(
        "result",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("place"),
    )
    return explode_records(placed, F.col("place"))


def _read_in_splits(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None, position: bool) -> DataFrame:
    texts = record_texts(spark, path)
    if schema is None:
        texts = materialize(texts)
        lines = scratch_path(spark, "records")
        # Line feeds between the tokens of a record are blanks to JSON, and within strings there are none.
        texts.select(F.translate("value", "\r\n", "  ")).write.text(lines)
        schema = spark.read.json(lines).schema
        if not schema.fields:
            raise ValueError(f"no record to infer columns from in {path}")
    parsed = texts.select(
        F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record"), F.struct("file", "start", "row").alias(POSITION)
    )
    return parsed.select(*flat_columns(F.col("record"), schema), *([POSITION] if position else []))

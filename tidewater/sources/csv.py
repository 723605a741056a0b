"""A1: scan a directory of CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT_COLUMN = "_corrupt_record"


def as_struct(spark: SparkSession, schema) -> StructType:
    """Accept a StructType or a DDL string."""
    if isinstance(schema, StructType):
        return schema
    if isinstance(schema, str):
        return StructType.fromDDL(schema)
    raise TypeError(f"schema must be a StructType or DDL string, not {type(schema).__name__}")


def with_corrupt_column(schema: StructType, name: str = CORRUPT_COLUMN) -> StructType:
    if name in schema.fieldNames():
        return schema
    return StructType([*schema.fields, StructField(name, StringType(), True)])


def csv_reader(spark: SparkSession, *, schema=None, strict=False, recursive=False,
               quarantine=True, streaming=False, options=None):
    """Configured CSV reader (batch or streaming) with the job's options.

    * first line of every file is the header; PERMISSIVE parsing;
    * ``schema`` None: types inferred (a full extra pass over the input);
      otherwise the declared schema is used and, with ``quarantine``, rows that
      do not parse keep their raw text in ``_corrupt_record``;
    * ``strict``: each file's header must match the schema by name
      (``enforceSchema=false``) instead of being mapped by position;
    * ``recursive``: also read files in subdirectories;
    * ``options``: further CSV reader options (``sep``, ``encoding``,
      ``multiLine``, ``nullValue`` ...); they may also override ``header`` and
      ``mode``.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.option("header", True).option("mode", "PERMISSIVE")
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    if strict:
        reader = reader.option("enforceSchema", False)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if schema is None:
        if streaming:
            raise ValueError("a streaming CSV source needs a declared schema")
        return reader.option("inferSchema", True)
    struct = as_struct(spark, schema)
    if quarantine:
        struct = with_corrupt_column(struct)
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    return reader.schema(struct)


def scan_csv(spark: SparkSession, path: str | list[str], schema=None, strict: bool = False,
             recursive: bool = False, quarantine: bool = True, options=None,
             by_header: bool = False) -> DataFrame:
    """Every CSV file directly in ``path`` as one DataFrame (see :func:`csv_reader`).

    ``by_header`` maps each file's columns by its own header instead of by position
    (:func:`tidewater.sources.headers.scan_by_header`)."""
    if by_header:
        from .headers import scan_by_header
        return scan_by_header(spark, path, schema, recursive=recursive, quarantine=quarantine, options=options,
                              missing="error" if strict else "null")
    reader = csv_reader(spark, schema=schema, strict=strict, recursive=recursive,
                        quarantine=quarantine, options=options)
    return reader.csv(path)

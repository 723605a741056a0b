"""A1 by header: CSV files whose headers differ, read together by column name.

Spark maps the columns of all files by the position they have in one of them.  Here the
headers are read first, by one distributed pass over the lines that keeps one line per file;
files are grouped by their header, each group is one CSV scan, and the scans are united by
name.  There are as many scans as different headers, however many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .csv import CORRUPT_COLUMN, as_struct, csv_reader, with_corrupt_column
from .schemas import ERROR, conform, unify, union_scans

#: Text reader options that find the same lines as the CSV reader.
_TEXT_OPTIONS = ("encoding", "charset", "lineSep", "pathGlobFilter", "modifiedAfter", "modifiedBefore",
                 "recursiveFileLookup")
#: More headers than this are taken for a mistake (files without header lines, for instance).
MAX_HEADERS = 200


class HeaderError(ValueError):
    """Headers that cannot be read together by name."""


def file_path(encoded: str = "_metadata.file_path") -> Column:
    """Path of a row's file as Hadoop writes it; ``_metadata.file_path`` has it percent-encoded."""
    return F.url_decode(F.replace(F.col(encoded), F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """``path`` for a reader that would take ``*``, ``[`` and the like as patterns."""
    return "".join("\\" + c if c in "\\*?[]{}," else c for c in path)


def _text_options(options, recursive: bool) -> dict[str, str]:
    """Those of the CSV options that say which lines the files hold."""
    known = {k.lower(): k for k in _TEXT_OPTIONS}
    found = {known[k.lower()]: v for k, v in (options or {}).items() if k.lower() in known}
    if "charset" in found:
        found.setdefault("encoding", found.pop("charset"))
    if recursive:
        found["recursiveFileLookup"] = "true"
    return found


def header_lines(spark: SparkSession, path: str | Sequence[str], *, recursive: bool = False, options=None) -> DataFrame:
    """``header, files``: each different header line with the paths of its files.

    A file's header is its first line that is neither blank nor a comment, as in the CSV
    reader; files without one are left out.  Every task keeps one line per file it reads, so
    neither its memory nor the shuffle grows with the lines.

    A minimum of texts alone would be a sort aggregate, for which every task sorts all its lines by
    file; beside ``collect_set`` (of few values: a file's blocks) it is hashed by file.  Hashing is
    given up beyond 128 files a task; a task has 32 at most under Spark's own limits for reads."""
    reader = spark.read
    for key, value in _text_options(options, recursive).items():
        reader = reader.option(key, value)
    lines = reader.text(path if isinstance(path, str) else list(path))
    named = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("at"), "value")
    some = named.filter(F.col("value").rlike(r"[^\x00-\x20\uFEFF]"))
    comment = {k.lower(): v for k, v in (options or {}).items()}.get("comment")
    if comment:
        some = some.filter(~F.startswith("value", F.lit(comment)))
    first = some.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("header"),
                                     F.collect_set("block").alias("blocks"))
    first = first.filter(F.size("blocks") > 0).select(file_path("file").alias("file"), "header")
    clean = F.regexp_replace("header", r"^\uFEFF|\r$", "")
    return first.groupBy(clean.alias("header")).agg(F.sort_array(F.collect_list("file")).alias("files"))


def _names(spark: SparkSession, file: str, options) -> tuple[str, ...]:
    """Column names of one file, parsed by the CSV reader (it reads the first line only)."""
    reader = spark.read.option("header", True)
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return tuple(reader.csv(literal_path(file)).columns)


def header_groups(spark: SparkSession, path: str | Sequence[str], *, recursive: bool = False,
                  options=None) -> list[tuple[tuple[str, ...], list[str]]]:
    """(column names, files) of each different header, in the order of their first files.  Header lines that differ in
    quoting alone have the same names."""
    # bounded: the paths that Spark's own listing holds on the driver, grouped
    rows = header_lines(spark, path, recursive=recursive, options=options).collect()
    if len(rows) > MAX_HEADERS:
        raise HeaderError(f"{len(rows)} different header lines; do the files have headers?")
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in sorted(rows, key=lambda r: r["files"][0]):
        groups.setdefault(_names(spark, row["files"][0], options), []).extend(row["files"])
    return [(names, sorted(files)) for names, files in groups.items()]


def _repeated(names: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Wanted columns that a header has more than once: the reader numbers those."""
    low = [n.lower() for n in names]
    return [w for w in wanted if w.lower() not in low and
            sum(n.startswith(w.lower()) and n[len(w):].isdigit() for n in low) > 1]


def scan_by_header(spark: SparkSession, path: str | Sequence[str], schema=None, *, recursive: bool = False,
                   quarantine: bool = True, options=None, missing: str = "null", keep_extra: bool | None = None,
                   on_conflict: str = ERROR, file_col: str | None = None) -> DataFrame:
    """Every CSV file in ``path``, columns by the name their own file's header gives them.

    * Declared ``schema``: its columns, found ignoring case; one that a file lacks is null
      there (``missing="error"``: :class:`HeaderError` names it and a file).  Other columns are
      left out unless ``keep_extra``; they are text then.  Rows that do not parse keep their text
      in ``_corrupt_record`` as in :func:`tidewater.sources.csv.scan_csv`.
    * No schema: types are inferred for each header and united to the widest ones
      (:func:`tidewater.sources.schemas.unify`); all columns are kept unless ``keep_extra=False``,
      which leaves those that all files have.
    * A wanted column that a header names twice is an error.  Files with no header have no
      rows.  ``file_col`` adds the path of each row's file.
    """
    if missing not in ("null", "error"):
        raise ValueError("missing is 'null' or 'error'")
    groups = header_groups(spark, path, recursive=recursive, options=options)
    declared = as_struct(spark, schema) if schema is not None else None
    if declared is None and not groups:
        raise HeaderError(f"no file with a header in {path}")
    scans, versions = [], []
    for names, files in groups:
        wanted = [f.name for f in declared.fields] if declared is not None else []
        twice = _repeated(names, wanted)
        absent = [w for w in wanted if w.lower() not in {n.lower() for n in names}]
        if twice or (absent and missing == "error"):
            problem = f"column {twice[0]!r} is named twice" if twice else f"no column {absent[0]!r}"
            raise HeaderError(f"{problem} in {files[0]} (header: {', '.join(names)})")
        own = None
        if declared is not None:
            types = {f.name.lower(): f.dataType for f in declared.fields}
            own = StructType([StructField(n, types.get(n.lower(), StringType()), True) for n in names])
        reader = csv_reader(spark, schema=own, quarantine=quarantine, options=options)
        df = reader.csv([literal_path(f) for f in files])
        versions.append((StructType([f for f in df.schema.fields if f.name != CORRUPT_COLUMN or f.name in names]),
                         [f.rsplit("/", 1)[-1] for f in files]))
        scans.append(df.select("*", file_path().alias(file_col)) if file_col else df)
    target = _target(declared, versions, keep_extra, on_conflict, scans)
    carry = [file_col] if file_col else []
    if declared is not None and quarantine:
        target = with_corrupt_column(target)
    if not scans:
        fields = [*target.fields, *[StructField(c, StringType()) for c in carry]]
        return spark.createDataFrame([], StructType(fields))
    return union_scans(scans, target, carry) if len(scans) > 1 else conform(scans[0], target, carry)


def _target(declared: StructType | None, versions, keep_extra: bool | None, on_conflict: str,
            scans: list[DataFrame]) -> StructType:
    if declared is not None:
        if not keep_extra:
            return StructType([StructField(f.name, f.dataType, True) for f in declared.fields])
        return unify([(declared, ["the schema"]), *versions], on_conflict)
    if keep_extra is False:
        common = set.intersection(*[{f.name.lower() for f in s.fields} for s, _ in versions])
        versions = [(StructType([f for f in s.fields if f.name.lower() in common]), at) for s, at in versions]
    return unify(versions, on_conflict, scans)

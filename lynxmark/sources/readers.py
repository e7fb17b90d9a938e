"""Files of published tables: CSV, TSV, JSON and XLSX in several encodings, and the bundle of all tables.

Paths are opened by Spark's file systems only.  The driver reads listings, a
file's first bytes and header rows; contents are read by tasks.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flexible_date, number, roc_year, whole
from .layout import COLUMNS, EXTENSIONS, INDEX, PATTERNS, kind, plain

HEAD = 4096
#: Encodings tried in this order, after UTF-8: Python's name and Java's.
ENCODINGS = (("cp950", "x-windows-950"), ("big5", "Big5"))


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file."""
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def encoding(spark: SparkSession, path: str) -> str:
    """Charset of a file: UTF-8 where all lines are valid, else the first of ``ENCODINGS`` that decodes all, else UTF-16 by its mark, else ISO-8859-1."""
    if head(spark, path, 2) in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    raw = spark.read.text(path)  # the lines as they are, not decoded
    if raw.select(F.bool_and(F.is_valid_utf8("value"))).first()[0] is not False:
        return "UTF-8"

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for name, _ in ENCODINGS:
                try:
                    for line in batch.column(0).to_pylist():
                        line.decode(name)
                    good.append(True)
                except UnicodeDecodeError:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([pa.array([g]) for g in good], names=[n for n, _ in ENCODINGS])

    lines = raw.select(F.col("value").cast("binary").alias("value"))
    verdict = lines.mapInArrow(tried, ", ".join(f"{n} boolean" for n, _ in ENCODINGS)).agg(*[F.bool_and(n).alias(n) for n, _ in ENCODINGS]).first()
    return next((java for name, java in ENCODINGS if verdict[name]), "ISO-8859-1")


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """All columns as text.  The separator is a tab where the first 4,096 characters hold more tabs than commas.

    ``multiline`` lets quoted values hold line ends, at the price of one task a
    file; turn it off for large files without such values.
    """
    charset = encoding(spark, path)
    if charset not in ("UTF-8", "UTF-16", "ISO-8859-1"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Big5 is no charset of Spark's own list
    names = {java: name for name, java in ENCODINGS}
    sample = head(spark, path, 4 * HEAD).decode(names.get(charset, charset), "ignore")[:HEAD]
    sep = "\t" if sample.count("\t") > sample.count(",") else ","
    options = {"header": True, "sep": sep, "encoding": charset, "multiLine": multiline, "quote": '"', "escape": '"', "nullValue": "", "enforceSchema": False}
    return spark.read.options(**options).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a list of objects, or of the first list that an object holds; no rows where it holds none.  A file is one value of under 2 GB."""
    whole_file = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"^[\s﻿]+", "").alias("v"))
    first, keys = whole_file.select(F.substring("v", 1, 1), F.when(F.startswith("v", F.lit("{")), F.json_object_keys("v"))).first() or ("", None)
    found = spark.read.option("multiLine", True).json(path)
    if first != "{":
        return found
    kinds = {f.name: f.dataType for f in found.schema}
    for key in keys or []:
        if key in kinds and kinds[key].typeName() == "array":
            rows = found.select(F.explode(F.col(f"`{key}`")).alias("row"))
            return rows.select("row.*") if kinds[key].elementType.typeName() == "struct" else spark.createDataFrame([], "value string")
    return spark.createDataFrame([], "value string")


def column_number(letters: str) -> int:
    """Place of a spreadsheet column, from 0."""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def sheet_rows(raw: bytes) -> Iterator[dict[int, str]]:
    """Rows of a workbook's first sheet as place: text; rows without cells are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
                if item.tag.endswith("}si"):
                    shared.append("".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")))
                    item.clear()
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet.*\.xml", n)), default=None)
        if sheet is None:
            return
        for _, row in ElementTree.iterparse(book.open(sheet)):
            if not row.tag.endswith("}row"):
                continue
            cells: dict[int, str] = {}
            for cell in row:
                parts = {p.tag.rsplit("}", 1)[-1]: p for p in cell}
                value = parts["v"].text or "" if "v" in parts else ""
                if cell.get("t") == "s" and "v" in parts:
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in parts["is"].iter() if t.tag.endswith("}t")) if "is" in parts else ""
                cells[column_number(re.sub(r"[^A-Z]", "", cell.get("r") or ""))] = value
            row.clear()
            if cells:
                yield cells


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, all as text: its first row names the columns (``col{i}`` beyond it), blank rows go.  A workbook is one task's work."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_ = pa.map_(pa.int32(), pa.string())
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for n, row in enumerate(sheet_rows(raw)):
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(row.items())], kind_)], names=["n", "cells"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(cells, "n long, cells map<int,string>")
    top = rows.agg(F.max(F.array_max(F.map_keys("cells"))), F.max_by("cells", F.when(F.col("n") == 0, 1))).first()
    if top is None or top[0] is None:
        return spark.createDataFrame([], "value string")
    names = [(top[1] or {}).get(i, "") if i <= max(top[1] or {0: ""}) else f"col{i}" for i in range(top[0] + 1)]
    last = {name: i for i, name in enumerate(names)}  # of a repeated name the last column counts
    filled = F.exists(F.map_values("cells"), lambda v: F.trim(v) != "")
    return rows.where((F.col("n") > 0) & filled).select(*[F.nullif(F.element_at("cells", F.lit(i)), F.lit("")).alias(name) for name, i in last.items()])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By its suffix: JSON, a workbook, else separated values."""
    low = path.lower()
    if low.endswith(".json"):
        return read_json(spark, path)
    return read_xlsx(spark, path) if low.endswith((".xlsx", ".xlsm")) else read_csv(spark, path)


def normalize(df: DataFrame, table: str) -> DataFrame:
    """Standard columns with their types; columns of other names go, but for those that begin with ``_``.

    Where several columns have one standard name the last counts.
    """
    chosen: dict[str, str] = {}
    for name in df.columns:
        standard = INDEX.get(plain(name)) or (name if name.startswith("_") else None)
        if standard:
            chosen[standard] = name
    cast = {"date": flexible_date, "int": roc_year, "bigint": whole, "double": number, "string": F.trim}
    out = []
    for standard, name in chosen.items():
        text = F.col("`" + name.replace("`", "``") + "`").cast("string")
        out.append(cast["string" if standard.startswith("_") else kind(table, standard)](text).alias(standard))
    return df.select(*out)


def find(spark: SparkSession, table: str, folders: list[str]) -> str | None:
    """File of a table: in the first folder with one that fits, the one with the shortest name, then the first by name."""
    for folder in folders:
        if not exists(spark, folder):
            continue
        fs, at = _fs(spark, folder)
        files, fits = fs.listFiles(at, True), []
        while files.hasNext():
            path = files.next().getPath()
            name = path.getName()
            if name.lower().endswith(EXTENSIONS) and any(p in name.lower() for p in PATTERNS[table]):
                fits.append((len(name), name, path.toString()))
        if fits:
            return min(fits)[2]
    return None


@dataclass
class Bundle:
    tables: dict[str, DataFrame]
    sources: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def load_tables(spark: SparkSession, folders: list[str], base: str | None = None) -> Bundle:
    """All tables of the domain: from ``folders``, else from where ``manifest.json`` or ``base`` says.

    A missing, empty or unreadable table is an empty one with its standard
    columns, and a warning.
    """
    bundle, manifest = Bundle({}), {}
    for folder in folders:
        if exists(spark, f"{folder}/manifest.json"):
            try:
                manifest = json.loads(head(spark, f"{folder}/manifest.json", 1 << 20).decode("utf-8-sig"))
            except ValueError as error:
                bundle.warnings.append(f"manifest.json: {error}")
            break
    for table in PATTERNS:
        places = [find(spark, table, folders), manifest.get(table) or (f"{base.rstrip('/')}/{table}.csv" if base else None)]
        for place in filter(None, places):
            try:
                found = normalize(read_any(spark, place), table)
                if found.columns and not found.isEmpty():
                    bundle.tables[table], bundle.sources[table] = found, place
                    break
            except Exception as error:  # whatever a file or store may raise becomes a warning, as for a missing file
                bundle.warnings.append(f"{place}: {str(error)[:200]}")
        else:
            schema = ", ".join(f"{c} {kind(table, c)}" for c in COLUMNS[table])
            bundle.tables[table] = spark.createDataFrame([], schema)
            bundle.warnings.append(f"{table}: not provided")
    return bundle

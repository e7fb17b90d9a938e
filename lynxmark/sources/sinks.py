"""Writers: guarded overwrite, append of new keys, accept and reject, templates, reports, JSON files, workbooks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from itertools import chain
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import _fs, exists

# Columns of the risk list and their titles, of its four dimensions, and of the schedule.
RISK_COLUMNS = {
    "rank": "風險排名", "inst_id": "機構代碼", "name": "機構名稱", "city": "縣市", "district": "行政區", "org_type": "設立類型", "score": "綜合風險分數", "band_label": "風險等級", "rule_score": "規則分數",
    "model_score": "模型分數", "anomaly_score": "異常偵測分數", "enrolled": "實際招收", "capacity": "核定人數", "pen_count_4y": "近四年裁罰", "pen_count_1y": "近一年裁罰", "senti_negative": "負面輿情則數",
    "urgency": "建議處理時效", "mode": "建議稽查模式",
}
DIMENSION_TITLES = {"compliance": "法遵風險", "financial": "財務風險", "evaluation": "評鑑風險", "sentiment": "輿情風險"}
REASONS = "主要風險因子"
SCHEDULE_COLUMNS = {
    "wave": "批次", "due": "處理時效", "inst_id": "機構代碼", "name": "機構名稱", "city": "縣市", "district": "行政區", "org_type": "設立類型", "score": "風險分數", "band_label": "風險等級", "mode": "建議稽查模式",
}
# Columns that a list of institutions shows.
LIST_COLUMNS = (
    "inst_id", "name", "city", "district", "org_type", "inst_kind", "enrolled", "capacity", "teacher_count", "score", "rule_score", "model_score", "anomaly_score",
    "band", "band_label", "color", "rank", "percentile", "dims", "pen_count_4y", "pen_count_1y", "senti_negative", "burst", "top_reasons", "urgency", "mode",
)
#: Rows that a sheet of the format can hold.
SHEET_ROWS = 1_048_576


def guarded_overwrite(df: DataFrame, path: str) -> bool:
    """Replace a Parquet table unless the new one has fewer rows.  It is written beside the old one and moved in its place, so readers of ``df`` may include the old table."""
    spark, side = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(side)
    fs, new = _fs(spark, side)
    _, old = _fs(spark, path)
    if exists(spark, path):
        if spark.read.schema(df.schema).parquet(side).count() < spark.read.parquet(path).count():
            fs.delete(new, True)
            return False
        _, away = _fs(spark, side + ".old")
        fs.rename(old, away)
        fs.rename(new, old)
        fs.delete(away, True)
    else:
        fs.rename(new, old)
    return True


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks; columns that one side lacks are null.  A key with a null is in neither side's matches and stays."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def split_rejects(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that no condition meets, and the others with the ``reason`` of the first that does; a null condition does not reject."""
    reason = F.coalesce(*[F.when(met, F.lit(name)) for name, met in reasons.items()])
    told = df.withColumn("reason", reason)
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL")


def write_templates(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """Every row of each table that has rows, as CSV with a header, a byte order mark in its first column's name; one folder a table."""
    done = []
    for name, df in tables.items():
        if not df.isEmpty():
            marked = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
            marked.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
            done.append(f"{folder}/{name}")
    return done


def write_risk_csv(df: DataFrame, path: str, reasons: str = "top_reasons") -> None:
    """Rows of a risk list with their list of reasons joined in one column."""
    df.withColumn(reasons, F.concat_ws("；", reasons)).write.mode("overwrite").option("header", True).csv(path)


def report_text(fields: dict[str, str]) -> Column:
    """One text of ``title: value`` lines; a null value shows a dash."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{title}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for title, c in fields.items()])


def write_json_files(df: DataFrame, path: str, key: str) -> None:
    """A folder of JSON lines for each value of ``key``; rows of one key are dealt to one task first, so a key has one file."""
    df.repartition(F.col(key)).withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(path)


def write_workbook(sheets: dict[str, DataFrame], path: str, ahead: dict[str, list[list]] | None = None) -> None:
    """An XLSX file with a sheet for each table, below the rows that ``ahead`` gives for it.  Rows stream through the driver, a partition at a time; more than the format holds is an error."""
    if not sheets:
        raise ValueError("a workbook has one sheet at least")
    spark = next(iter(sheets.values())).sparkSession
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, top = "http://schemas.openxmlformats.org/package/2006", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    names = range(1, len(sheets) + 1)

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) != float("inf"):
            return f"<c><v>{value}</v></c>"
        text = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    def letters(n: int) -> str:
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    with tempfile.TemporaryFile() as held:
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in names)
            book.writestr("[Content_Types].xml", f'{top}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
            book.writestr("_rels/.rels", f'{top}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(names, sheets))
            book.writestr("xl/workbook.xml", f'{top}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in names)
            book.writestr("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
            for i, (name, df) in zip(names, sheets.items()):
                with book.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                    out.write(f'{top}<worksheet xmlns="{main}"><sheetData>'.encode())
                    for n, row in enumerate(chain((ahead or {}).get(name, []), _with_header(df)), 1):
                        if n > SHEET_ROWS:
                            raise ValueError(f"a sheet holds no more than {SHEET_ROWS} rows")
                        cells = "".join(cell(v).replace("<c", f'<c r="{letters(k)}{n}"', 1) for k, v in enumerate(row))
                        out.write(f'<row r="{n}">{cells}</row>'.encode())
                    out.write(b"</sheetData></worksheet>")
        fs, at = _fs(spark, path)
        stream = fs.create(at, True)
        try:
            held.seek(0)
            while part := held.read(1 << 20):
                stream.write(bytearray(part))
        finally:
            stream.close()


def _with_header(df: DataFrame):
    yield df.columns
    yield from df.toLocalIterator()


def save_settings(spark, path: str, settings: dict) -> None:
    """Settings or reports as one JSON file, written beside its place and then renamed."""
    import json
    import uuid

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = at.getFileSystem(conf)
    stream = fs.create(draft, True)
    stream.write(bytearray(json.dumps(settings, ensure_ascii=False, indent=1).encode()))
    stream.close()
    fs.delete(at, False)
    fs.rename(draft, at)


def load_settings(spark, path: str, defaults: dict) -> dict:
    """The saved settings over the defaults, of which they can change values only; the defaults where no file is."""
    import json

    from ..operators.registers import settings_of

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return dict(defaults)
    stream = fs.open(at)
    try:
        return settings_of(json.loads(bytes(stream.readAllBytes()).decode()), defaults)
    finally:
        stream.close()


def _titled(df: DataFrame, columns: dict[str, str]) -> list[Column]:
    """Columns under their titles; one that the table lacks is null."""
    return [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(title) for c, title in columns.items()]


def risk_list(rows: DataFrame) -> DataFrame:
    """The 18 columns of the risk list, the dimensions to two places and the main reasons in one text."""
    dims = [F.round(F.coalesce(F.col(d).cast("double"), F.lit(0.0)) if d in rows.columns else F.lit(0.0), 2).alias(title) for d, title in DIMENSION_TITLES.items()]
    return rows.select(*_titled(rows, RISK_COLUMNS), *dims, F.concat_ws("；", "top_reasons").alias(REASONS))


def schedule_list(rows: DataFrame) -> DataFrame:
    return rows.select(*_titled(rows, SCHEDULE_COLUMNS), F.concat_ws("；", "top_reasons").alias(REASONS))


def write_risk_workbook(path: str, rows: DataFrame, schedule: DataFrame, efficiency: dict, at_k: DataFrame, measures: dict, importance: DataFrame, stand: str = "") -> None:
    """Risk list, schedule and validation as a workbook of three sheets.

    ``at_k`` has k, precision, recall and lift; ``importance`` feature, coef and
    odds_ratio, of which the 25 largest are shown below.  The figures of
    ``efficiency`` and ``measures`` stand above their tables.
    """
    names = ("風險清冊", "稽查排程建議", "模型驗證")
    pairs = lambda d: [[k, v] for k, v in d.items()]
    order = lambda df, c: df.orderBy(c) if c in df.columns else df
    shown = at_k.orderBy("k").select(F.col("k").cast("string").alias("K"), *(F.col(c).cast("double").alias(title) for c, title in (("precision", "Precision@K"), ("recall", "Recall@K"), ("lift", "Lift"))))
    # 25 rows.
    top = [["特徵", "係數", "勝算比"], *([r.feature, r.coef, r.odds_ratio] for r in importance.orderBy(F.desc(F.abs("coef")), "feature").limit(25).collect()), []]
    write_workbook(
        {names[0]: risk_list(order(rows, "rank")), names[1]: schedule_list(order(schedule, "rank")), names[2]: shown}, path,
        {names[0]: [["教保機構風險預警清冊"], [stand], []], names[1]: [["稽查資源配置建議"], [], *pairs(efficiency), []], names[2]: [["模型驗證與有效性指標"], [], *pairs(measures), [], *top]},
    )


def write_static(folder: str, endpoints: dict[str, DataFrame], rows: DataFrame, details: DataFrame, key: str = "inst_id") -> None:
    """What pages without a server read: JSON lines of each endpoint, the list of institutions with its own columns only, and a folder for the details of each institution."""
    for name, df in {**endpoints, "institutions": rows.select(*(c for c in LIST_COLUMNS if c in rows.columns))}.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    write_json_files(details, f"{folder}/institution", key)

"""Readers and writers: CSV and Parquet tables, JSON documents, the narrative, a one-sheet workbook."""

from __future__ import annotations

import io
import json
import math
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, sep: str = ";", drop_null: bool = False) -> DataFrame:
    df = spark.read.option("sep", sep).option("header", True).csv(path, inferSchema=True)
    return df.na.drop() if drop_null else df


def save_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Written by the executors, as a folder."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def plain(x):
    """JSON without NaN and infinities, of plain Python values."""
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set):
        return [plain(v) for v in x]
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def save_bytes(path: str, data: bytes, spark: SparkSession) -> None:
    """One file, by the file system that Spark finds for its path, so that it lies where the tables do."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def save_json(path: str, value, spark: SparkSession) -> None:
    save_bytes(path, json.dumps(plain(value), ensure_ascii=False, indent=2).encode(), spark)


def save_workbook(path: str, rows: list[dict], spark: SparkSession) -> None:
    """A workbook of one sheet, written as its parts; numbers as numbers, the rest as text."""
    head = list(rows[0]) if rows else []
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) else f'<c t="inlineStr"><is><t>{escape("" if v is None else str(v))}</t></is></c>'
    body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [head, *[[x.get(h) for h in head] for x in rows]])
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="summary" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{text}')
    save_bytes(path, held.getvalue(), spark)

"""Results to files: JSON, CSV, workbooks, an index of runs; what is small is written by the driver, the rest by Spark."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_atomic(path: str, data: bytes) -> None:
    """Through a file next to it that takes the name at the end."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "wb") as f:
        f.write(data)
    os.replace(name, path)


def write_retained(retained: DataFrame, path: str) -> None:
    retained.write.mode("overwrite").partitionBy("run_id").parquet(path)


def write_runs(results: DataFrame, path: str) -> None:
    """A JSON folder for each run."""
    results.write.mode("overwrite").partitionBy("run_id").json(path)


def safe(text: object) -> object:
    """A text that a spreadsheet won't take for a formula."""
    return f"'{text}" if isinstance(text, str) and text[:1] in ("=", "+", "-", "@", "\t", "\r") else text


def safe_columns(df: DataFrame) -> DataFrame:
    fix = lambda c: F.when(F.col(c).rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c)
    return df.select(*[fix(c) if t == "string" else c for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files, safe to open in a spreadsheet."""
    safe_columns(df).write.mode("overwrite").option("header", True).csv(path)


def to_csv(rows: list, columns: list[str]) -> bytes:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(columns)
    w.writerows([[safe(r[c]) for c in columns] for r in rows])
    return out.getvalue().encode()


def summary(results: DataFrame) -> dict:
    """Counts by verdict over all runs, canonical for JSON."""
    counts = {r["verdict"]: r["n"] for r in results.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"counts": dict(sorted(counts.items())), "runs": results.select("run_id").distinct().count()}


def canonical(data: object) -> bytes:
    return json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def to_xlsx(sheets: dict[str, tuple[list[str], list[list]]]) -> bytes:
    """A workbook of a sheet for each table. The same tables give the same bytes."""
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

    def column(i: int) -> str:
        name = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            name = chr(65 + r) + name
        return name

    def cell(r: int, c: int, value: object) -> str:
        at = f"{column(c)}{r + 1}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    def sheet(columns: list[str], rows: list[list]) -> str:
        lines = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate([columns, *rows]))
        return f'{head}<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>'

    n = range(1, len(sheets) + 1)
    files = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(s[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(n, sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>",
        **{f"xl/worksheets/sheet{i}.xml": sheet(*s) for i, s in zip(n, sheets.values())},
    }
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in files.items():
            book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def results_workbook(results: DataFrame, stats: DataFrame, most: int = 100_000) -> bytes:
    """Requirements, runs and verdicts in one workbook; of more rows than a sheet holds, the worst come first."""
    order = F.expr("array_position(array('fail','error','warn','pass','not_applicable'), verdict)")
    rows = results.orderBy(order, "id", "run_id").limit(most).collect()
    found = stats.orderBy("id").collect()
    return to_xlsx({"Requirements": (stats.columns, [list(r) for r in found]), "Results": (results.columns, [list(r) for r in rows])})


def annotate(rows: list[list[object]], header: int, sentences: dict[str, str], id_column: int, label: str = "Verdict") -> list[list[object]]:
    """A copy of a requirements table with a sentence for each requirement in a column of its own."""
    width = max(map(len, rows))
    out = []
    for i, row in enumerate(rows):
        text = label if i == header else sentences.get(str(row[id_column] if id_column < len(row) else ""), "") if i > header else ""
        out.append([*row, *[None] * (width - len(row)), text])
    return out

"""Small tables read on the driver: CSV, workbooks (XLSX) and ReqIF to rows of cells, with the standard library only."""

from __future__ import annotations

import csv
import html
import io
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree as ET

#: Limits against archives that unpack to more than they should, and number formats that are percentages or dates.
MOST_BYTES, MOST_RATIO = 256 << 20, 200
PERCENT_FORMATS, DATE_FORMATS = {9, 10}, {*range(14, 23), 45, 46, 47}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class SourceError(ValueError):
    """A file that can't be read as what it claims to be."""


def sniff_delimiter(lines: list[str]) -> str:
    """The separator that cuts the first lines into the same number of cells, most cells first."""
    best, most = ",", 0
    for d in (",", ";", "\t"):
        counts = {len(next(csv.reader([x], delimiter=d))) for x in lines if x.strip()}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = d, n
    return best


def read_csv(path: str | Path, delimiter: str | None = None, encoding: str = "utf-8-sig") -> list[list[str]]:
    text = Path(path).read_bytes().decode(encoding)
    return list(csv.reader(io.StringIO(text), delimiter=delimiter or sniff_delimiter(text.splitlines()[:20])))


def _part(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in book.namelist():
        return None
    info = book.getinfo(name)
    if info.file_size > MOST_BYTES or info.file_size > MOST_RATIO * max(info.compress_size, 1024):
        raise SourceError(f"{name} unpacks to too much")
    data = book.read(name)
    if b"<!DOCTYPE" in data[:2000]:
        raise SourceError(f"{name} declares a document type")
    return ET.fromstring(data)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets(path: str | Path) -> list[str]:
    with zipfile.ZipFile(path) as book:
        return [s.get("name") for s in _part(book, "xl/workbook.xml").iter(f"{_MAIN}sheet")]


def read_xlsx(path: str | Path, sheet: str | None = None) -> list[list[object]]:
    """Rows of one sheet, the first by default. Merged cells repeat their value; a formula without a value is an error."""
    with zipfile.ZipFile(path) as book:
        workbook, links = _part(book, "xl/workbook.xml"), _part(book, "xl/_rels/workbook.xml.rels")
        if workbook is None or links is None:
            raise SourceError(f"{path} isn't a workbook")
        target = {r.get("Id"): r.get("Target") for r in links}
        found = {s.get("name"): target[s.get(f"{_REL}id")] for s in workbook.iter(f"{_MAIN}sheet")}
        if sheet is not None and sheet not in found:
            raise SourceError(f"no sheet {sheet!r}; there are {', '.join(found)}")
        name = found[sheet] if sheet is not None else next(iter(found.values()))
        shared = _part(book, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in shared.iter(f"{_MAIN}si")] if shared is not None else []
        styles = _part(book, "xl/styles.xml")
        formats = [int(x.get("numFmtId", 0)) for x in styles.find(f"{_MAIN}cellXfs")] if styles is not None and styles.find(f"{_MAIN}cellXfs") is not None else []
        root = _part(book, name.lstrip("/") if name.startswith("/") else f"xl/{name}")
        rows: dict[int, dict[int, object]] = {}
        for cell in root.iter(f"{_MAIN}c"):
            at = cell.get("r")
            r, c = int(re.search(r"\d+", at)[0]) - 1, _column(at)
            kind, value = cell.get("t"), cell.findtext(f"{_MAIN}v")
            if kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif value is None:
                if cell.find(f"{_MAIN}f") is not None:
                    raise SourceError(f"{at}: a formula without a saved value")
                continue
            elif kind == "s":
                value = strings[int(value)]
            elif kind == "b":
                value = value == "1"
            elif kind not in ("str", "e"):
                number = float(value)
                style = int(cell.get("s", 0))
                form = formats[style] if style < len(formats) else 0
                value = f"{number * 100:g} %" if form in PERCENT_FORMATS else int(number) if number == int(number) else number
            rows.setdefault(r, {})[c] = value
        for m in root.iter(f"{_MAIN}mergeCell"):
            a, z = (m.get("ref").split(":") * 2)[:2]
            (r0, c0), (r1, c1) = ((int(re.search(r"\d+", x)[0]) - 1, _column(x)) for x in (a, z))
            for r in range(r0, r1 + 1):
                for c in range(c0, c1 + 1):
                    rows.setdefault(r, {}).setdefault(c, rows.get(r0, {}).get(c0))
    width = 1 + max((c for row in rows.values() for c in row), default=-1)
    return [[rows.get(r, {}).get(c) for c in range(width)] for r in range(1 + max(rows, default=-1))]


def read_reqif(path: str | Path) -> list[list[object]]:
    """Spec objects of a ReqIF or zipped ReqIF file as rows, a column for each attribute."""
    data = Path(path).read_bytes()
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            data = book.read(next(n for n in book.namelist() if n.endswith(".reqif")))
    if b"<!DOCTYPE" in data[:2000]:
        raise SourceError("the file declares a document type")
    root = ET.fromstring(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    names = {e.get("IDENTIFIER"): e.get("LONG-NAME") for e in root.iter() if local(e).startswith("ATTRIBUTE-DEFINITION-") and e.get("IDENTIFIER")}
    choices = {e.get("IDENTIFIER"): e.get("LONG-NAME") for e in root.iter() if local(e) == "ENUM-VALUE"}
    objects, header = [], ["ID"]
    for spec in (e for e in root.iter() if local(e) == "SPEC-OBJECT"):
        row = {"ID": spec.get("LONG-NAME") or spec.get("IDENTIFIER")}
        for value in (e for e in spec.iter() if local(e).startswith("ATTRIBUTE-VALUE-")):
            name = next((names.get((r.text or "").strip()) for r in value.iter() if local(r).startswith("ATTRIBUTE-DEFINITION-") and (r.text or "").strip()), None)
            if name is None:
                continue
            if local(value).endswith("XHTML"):
                text = " ".join("".join(value.itertext()).split())
            elif local(value).endswith("ENUMERATION"):
                text = ", ".join(choices.get((r.text or "").strip(), "") for r in value.iter() if local(r) == "ENUM-VALUE-REF")
            else:
                text = value.get("THE-VALUE")
            row["ID" if name == "ReqIF.ForeignID" else name] = html.unescape(text or "")
            if name != "ReqIF.ForeignID" and name not in header:
                header.append(name)
        objects.append(row)
    return [header, *[[o.get(h) for h in header] for o in objects]]


def read_table(path: str | Path, sheet: str | None = None, delimiter: str | None = None) -> list[list[object]]:
    """Rows of a requirements table by the extension of its file."""
    suffix = Path(path).suffix.lower()
    if suffix in (".xlsx", ".xlsm"):
        return read_xlsx(path, sheet)
    if suffix in (".reqif", ".reqifz"):
        return read_reqif(path)
    return read_csv(path, "\t" if suffix == ".tsv" and delimiter is None else delimiter)

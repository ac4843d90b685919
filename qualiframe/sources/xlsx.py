"""Excel workbooks by the standard library: reading sheets and writing one."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATES = {14, 15, 16, 17, 22}


def sheet_names(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)]


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def read_sheet(data: bytes, sheet: str | None = None) -> Iterator[list[object]]:
    """Rows of a sheet, the first by default: text, float, bool, datetime or None; rows have the width of the sheet so far."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        sheets = {s.get("name"): s.get(_REL) for s in book.iterfind("m:sheets/m:sheet", _NS)}
        if sheet is not None and sheet not in sheets:
            raise KeyError(sheet)
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[sheets[sheet] if sheet else next(iter(sheets.values()))].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        dated: set[int] = set()
        if "xl/styles.xml" in z.namelist():
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iterfind("m:numFmts/m:numFmt", _NS)}
            for i, xf in enumerate(styles.iterfind("m:cellXfs/m:xf", _NS)):
                k = int(xf.get("numFmtId", 0))
                if k in _DATES or re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, "")).lower()):
                    dated.add(i)
        width = 0
        for row in ET.fromstring(z.read(path)).iterfind("m:sheetData/m:row", _NS):
            cells: list[object] = []
            for c in row.iterfind("m:c", _NS):
                at = _column(c.get("r")) if c.get("r") else len(cells)  # a cell without a place follows the one before
                cells += [None] * (at + 1 - len(cells))
                v, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is not None and v.text is not None:
                    if kind == "s":
                        cells[at] = shared[int(v.text)]
                    elif kind in ("str", "e"):
                        cells[at] = v.text
                    elif kind == "b":
                        cells[at] = v.text == "1"
                    else:
                        number = float(v.text)
                        cells[at] = datetime(1899, 12, 30) + timedelta(days=number) if int(c.get("s", -1)) in dated else number
            width = max(width, len(cells))
            yield cells + [None] * (width - len(cells))


def write_sheet(header: list[str], rows: Iterable[Iterable[object]], name: str = "Cleaned") -> bytes:
    """A workbook with one sheet of inline text and numbers, written row by row."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode())
            for row in _with(header, rows):
                f.write(("<row>" + "".join(_cell(v) for v in row) + "</row>").encode("utf-8", "replace"))
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _with(header: list[str], rows: Iterable[Iterable[object]]) -> Iterator[Iterable[object]]:
    yield header
    yield from rows


def _cell(v: object) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c><v>{v!r}</v></c>"
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

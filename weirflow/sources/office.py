"""Office documents: text and structure of DOCX, PPTX and XLSX, read from bytes, never executed.

Archives are opened with limits (entries, sizes, compression ratio); entries that climb out of the archive and links are skipped. Defined cases: null bytes give null, broken archives a row with an error, empty documents empty lists.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits on archives.
MOST_ENTRIES, MOST_TOTAL, MOST_ENTRY, MOST_RATIO = 4_096, 512 << 20, 128 << 20, 200

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


class Refused(ValueError):
    """An archive beyond the limits, or none at all."""


def opened(data: bytes) -> dict[str, bytes]:
    """Entries of an archive within the limits, by name."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Refused("no archive") from e
    infos = z.infolist()
    if len(infos) > MOST_ENTRIES:
        raise Refused("too many entries")
    if sum(i.file_size for i in infos) > MOST_TOTAL:
        raise Refused("too large")
    out = {}
    for i in infos:
        link = (i.external_attr >> 16) & 0o170000 == 0o120000
        if i.is_dir() or link or i.filename.startswith("/") or ".." in i.filename.split("/") or "\\" in i.filename:
            continue
        if i.file_size > MOST_ENTRY or i.file_size > MOST_RATIO * max(1, i.compress_size):
            raise Refused("entry beyond the limits")
        with z.open(i) as f:
            out[i.filename] = f.read(MOST_ENTRY + 1)[:MOST_ENTRY]
    return out


def _xml(data: bytes | None):
    if not data or b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data:
        return None
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise Refused("broken part") from e


def docx(data: bytes) -> dict:
    """paragraphs, tables (of rows of cells), notes, comments, macros, images, changes of a text document."""
    parts = opened(data)
    body = _xml(parts.get("word/document.xml"))
    if body is None:
        raise Refused("no document")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    in_tables = {id(p) for t in body.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
    tables = [[[said(c) for c in r.iter(f"{_W}tc")] for r in t.iter(f"{_W}tr")] for t in body.iter(f"{_W}tbl")]
    extra = lambda name, tag: [said(e) for e in (_xml(parts.get(name)) if parts.get(name) else []) or [] if e.tag == f"{_W}{tag}" and said(e)]
    return {
        "paragraphs": [said(p) for p in body.iter(f"{_W}p") if id(p) not in in_tables and said(p)],
        "tables": tables,
        "notes": extra("word/footnotes.xml", "footnote") + extra("word/endnotes.xml", "endnote"),
        "comments": extra("word/comments.xml", "comment"),
        "macros": any(n.endswith("vbaProject.bin") for n in parts),
        "images": sum(n.startswith("word/media/") for n in parts),
        "changes": sum(1 for _ in body.iter(f"{_W}ins")) + sum(1 for _ in body.iter(f"{_W}del")),
    }


def pptx(data: bytes) -> list[dict]:
    """number, text, notes, hidden of the slides, in their order."""
    parts = opened(data)
    out = []
    for name in sorted((n for n in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
        k = int(re.findall(r"\d+", name)[0])
        slide = _xml(parts[name])
        note = _xml(parts.get(f"ppt/notesSlides/notesSlide{k}.xml"))
        lines = lambda e: ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in e.iter(f"{_A}p")] if e is not None else []
        out.append({"number": k, "text": [x for x in lines(slide) if x], "notes": [x for x in lines(note) if x], "hidden": slide is not None and slide.get("show") == "0"})
    return out


def xlsx(data: bytes) -> list[dict]:
    """name, rows of the sheets; cells as text, gaps as empty cells."""
    parts = opened(data)
    book = _xml(parts.get("xl/workbook.xml"))
    if book is None:
        raise Refused("no workbook")
    strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in (_xml(parts.get("xl/sharedStrings.xml")) if parts.get("xl/sharedStrings.xml") else []) or []]
    names = [s.get("name") for s in book.iter(f"{_S}sheet")]
    out = []
    for k, name in enumerate(names, 1):
        sheet = _xml(parts.get(f"xl/worksheets/sheet{k}.xml"))
        rows = []
        for r in sheet.iter(f"{_S}row") if sheet is not None else []:
            cells: list[str] = []
            for c in r.iter(f"{_S}c"):
                at = 0
                for ch in re.match(r"[A-Z]*", c.get("r") or "").group():
                    at = at * 26 + ord(ch) - 64
                cells += [""] * max(0, at - 1 - len(cells))
                v = c.find(f"{_S}v")
                text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells.append(strings[int(text)] if c.get("t") == "s" and text.isdigit() and int(text) < len(strings) else text)
            rows.append(cells)
        out.append({"name": name, "rows": rows})
    return out


def _column(schema: str, f, empty):
    def make(raw: Column) -> Column:
        @F.pandas_udf(schema)
        def run(values: pd.Series) -> pd.DataFrame:
            out = []
            for b in values:
                try:
                    out.append((None, "null") if b is None else (f(bytes(b)), None))
                except Refused as e:
                    out.append((empty, str(e)))
            return pd.DataFrame(out, columns=["content", "error"])

        return run(raw)

    return make


read_docx = _column("content struct<paragraphs: array<string>, tables: array<array<array<string>>>, notes: array<string>, comments: array<string>, macros: boolean, images: int, changes: int>, error string", docx, None)
read_pptx = _column("content array<struct<number: int, text: array<string>, notes: array<string>, hidden: boolean>>, error string", pptx, None)
read_xlsx = _column("content array<struct<name: string, rows: array<array<string>>>>, error string", xlsx, None)

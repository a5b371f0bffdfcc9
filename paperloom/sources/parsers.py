"""Office and mail documents, parsed inside tasks from ``(path, content)`` rows.

A file that cannot be parsed gives one row with ``status = 'failed'`` and the reason.
"""

from __future__ import annotations

import email
import email.policy
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

ROWS_PER_BATCH = 10_000
OFFICE_SCHEMA = (
    "path string, part string, position int, sheet string, row int, col string, value string, "
    "status string, error string"
)
MAIL_SCHEMA = (
    "path string, sender string, recipient string, subject string, sent string, body string, "
    "status string, error string"
)
MAIL_COLUMNS = [c.split()[0] for c in MAIL_SCHEMA.split(", ")]
OFFICE_COLUMNS = [c.split()[0] for c in OFFICE_SCHEMA.split(", ")]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes) -> list[str]:
    """Text of each paragraph that has any; breaks and tabs become white space."""
    found = []
    for node in ElementTree.fromstring(xml).iter():
        if _local(node.tag) == "p":
            pieces = []
            for leaf in node.iter():
                name = _local(leaf.tag)
                if name == "t":
                    pieces.append(leaf.text or "")
                elif name == "br":
                    pieces.append("\n")
                elif name == "tab":
                    pieces.append("\t")
            if "".join(pieces):
                found.append("".join(pieces))
    return found


def _document_rows(archive: zipfile.ZipFile) -> Iterator[dict]:
    for position, value in enumerate(_paragraphs(archive.read("word/document.xml"))):
        yield {"part": "body", "position": position, "value": value}


def _slide_rows(archive: zipfile.ZipFile) -> Iterator[dict]:
    slides = [n for n in archive.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)]
    for name in sorted(slides, key=lambda n: int(re.search(r"\d+", posixpath.basename(n)).group())):
        number = re.search(r"\d+", posixpath.basename(name)).group()
        for position, value in enumerate(_paragraphs(archive.read(name))):
            yield {"part": f"slide{number}", "position": position, "value": value}


def _text_of(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")


def _sheet_rows(archive: zipfile.ZipFile) -> Iterator[dict]:
    names = archive.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        items = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
        shared = [_text_of(item) for item in items if _local(item.tag) == "si"]
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    targets = {link.get("Id"): link.get("Target") for link in links}
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter():
        if _local(sheet.tag) != "sheet":
            continue
        link = next(v for k, v in sheet.attrib.items() if _local(k) == "id")
        target = posixpath.normpath(posixpath.join("/xl", targets[link])).lstrip("/")
        for cell in ElementTree.fromstring(archive.read(target)).iter():
            if _local(cell.tag) != "c":
                continue
            column, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            raw = next((v.text or "" for v in cell if _local(v.tag) == "v"), None)
            if cell.get("t") == "inlineStr":
                value = _text_of(cell)
            elif cell.get("t") == "s" and raw is not None:
                value = shared[int(raw)]
            else:
                value = raw
            if value is not None:
                yield {"part": "cell", "sheet": sheet.get("name"), "row": int(row), "col": column, "value": value}


# Suffix to reader.
OFFICE_READERS: dict[str, Callable[[zipfile.ZipFile], Iterator[dict]]] = {
    ".docx": _document_rows,
    ".pptx": _slide_rows,
    ".xlsx": _sheet_rows,
}


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    values = {c: [row.get(c) for row in rows] for c in columns}
    numbers = {c: pd.array(values[c], dtype="Int32") for c in columns if c in ("position", "row")}
    return pd.DataFrame({c: numbers.get(c, pd.Series(values[c], dtype=object)) for c in columns})


def _office_rows(path: str, content: bytes) -> list[dict]:
    try:
        reader = OFFICE_READERS[posixpath.splitext(path)[1]]
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            rows = [{"path": path, "status": "success", **row} for row in reader(archive)]
        return rows or [{"path": path, "status": "success", "part": "empty"}]
    except Exception as problem:
        return [{"path": path, "status": "failed", "error": f"{type(problem).__name__}: {problem}"}]


def _office_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows: list[dict] = []
        for path, content in zip(part["path"], part["content"]):
            rows.extend(_office_rows(path, content))
            if len(rows) >= ROWS_PER_BATCH:
                yield _frame(rows, OFFICE_COLUMNS)
                rows = []
        if rows:
            yield _frame(rows, OFFICE_COLUMNS)


def _header(message: email.message.EmailMessage, name: str) -> str | None:
    value = message[name]  # parsed anew at every access
    return value and str(value)


def _mail_body(message: email.message.EmailMessage) -> str:
    body = message.get_body(preferencelist=("plain", "html"))
    return body.get_content() if body is not None else ""


def _mail_batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for path, content in zip(part["path"], part["content"]):
            row = {"path": path}
            try:
                message = email.message_from_bytes(bytes(content), policy=email.policy.default)
                if not message.keys():
                    raise ValueError("no mail headers")
                row.update(
                    sender=_header(message, "from"),
                    recipient=_header(message, "to"),
                    subject=_header(message, "subject"),
                    sent=_header(message, "date"),
                    body=_mail_body(message),
                    status="success",
                )
            except Exception as problem:
                row.update(status="failed", error=f"{type(problem).__name__}: {problem}")
            rows.append(row)
        yield _frame(rows, MAIL_COLUMNS)


def parse_office(files: DataFrame) -> DataFrame:
    """Paragraphs of .docx and .pptx, cells of .xlsx, one row each."""
    return files.select("path", "content").mapInPandas(_office_batches, OFFICE_SCHEMA)


def parse_email(files: DataFrame) -> DataFrame:
    """Headers and body of .eml files, one row per file."""
    return files.select("path", "content").mapInPandas(_mail_batches, MAIL_SCHEMA)

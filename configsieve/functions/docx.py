"""Text and pictures of a DOCX archive, with the standard library only."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN_PART = "word/document.xml"
MEDIA_PREFIX = "word/media/"
BROKEN = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, TypeError)

# What an element inside a run stands for in the text.
RUN_TEXT = {W + "tab": "\t", W + "cr": "\n", W + "noBreakHyphen": "-", W + "ptab": "\t"}


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then the non-blank cells of every table row joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read(MAIN_PART)).find(W + "body")
    lines = [t for t in map(paragraph_text, body.findall(W + "p")) if t.strip()]
    for table in body.findall(W + "tbl"):
        lines.extend(" | ".join(row) for row in table_rows(table) if row)
    return "\n".join(lines)


def docx_media(content: bytes) -> Iterator[tuple[str, bytes]]:
    """``(member name, content)`` of the embedded pictures, unpacked as they are asked for.

    A broken archive has none, a broken picture is left out.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except BROKEN:
        return
    with archive:
        for name in sorted(n for n in archive.namelist() if n.startswith(MEDIA_PREFIX) and not n.endswith("/")):
            try:
                picture = archive.read(name)
            except BROKEN:
                continue
            yield name, picture


def paragraph_text(paragraph) -> str:
    """Text of the runs of a paragraph, those inside hyperlinks included."""
    runs = []
    for child in paragraph:
        if child.tag == W + "r":
            runs.append(child)
        elif child.tag == W + "hyperlink":
            runs.extend(child.findall(W + "r"))
    return "".join(element_text(e) for run in runs for e in run)


def element_text(element) -> str:
    if element.tag == W + "t":
        return element.text or ""
    if element.tag == W + "br":
        return "\n" if element.get(W + "type", "textWrapping") == "textWrapping" else ""
    return RUN_TEXT.get(element.tag, "")


def table_rows(table) -> Iterator[list[str]]:
    """Trimmed non-blank cell texts per row.

    A cell counts once per grid column it spans, and a cell merged downwards
    counts again in every row it reaches.
    """
    above: list[str] = []
    for row in table.findall(W + "tr"):
        grid: list[str] = []
        for cell in row.findall(W + "tc"):
            properties = cell.find(W + "tcPr")
            span, merge = 1, None
            if properties is not None:
                grid_span = properties.find(W + "gridSpan")
                span = int(grid_span.get(W + "val", "1")) if grid_span is not None else 1
                merge = properties.find(W + "vMerge")
            continued = merge is not None and merge.get(W + "val", "continue") == "continue"
            if continued and len(grid) < len(above):
                text = above[len(grid)]
            else:
                text = "\n".join(map(paragraph_text, cell.findall(W + "p"))).strip()
            grid.extend([text] * span)
        yield [t for t in grid if t]
        above = grid

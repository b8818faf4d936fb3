"""Small .xlsx files for tests and derived inputs, written with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Collection, Mapping, Sequence
from xml.sax.saxutils import escape, quoteattr

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
STYLES = (
    f'<styleSheet xmlns="{MAIN}"><numFmts count="1"><numFmt numFmtId="164" '
    'formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs count="3"><xf numFmtId="0"/>'
    '<xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
)

Cell = str | int | float | bool | None


def letters(column: int) -> str:
    """Column letters of a 0-based index."""
    text = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        text = chr(ord("A") + rest) + text
    return text


def pack_workbook(
    sheets: Mapping[str, Sequence[Sequence[Cell]]],
    shared: bool = False,
    date_columns: Collection[int] = (),
) -> bytes:
    """Bytes of a workbook; empty rows are left out of the file, as editors do.

    Numbers in `date_columns` get a date style, texts are shared or inline.
    """
    strings: dict[str, int] = {}

    def cell_xml(value: Cell, row: int, column: int) -> str:
        reference = f'r="{letters(column)}{row + 1}"'
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c {reference} t="b"><v>{int(value)}</v></c>'
        if isinstance(value, str) and shared:
            index = strings.setdefault(value, len(strings))
            return f'<c {reference} t="s"><v>{index}</v></c>'
        if isinstance(value, str):
            return f'<c {reference} t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        style = ' s="2"' if column in date_columns else ""
        return f"<c {reference}{style}><v>{value}</v></c>"

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        entries, links = [], []
        for number, (name, rows) in enumerate(sheets.items(), 1):
            body = "".join(
                f'<row r="{r + 1}">{"".join(cell_xml(v, r, c) for c, v in enumerate(row))}</row>'
                for r, row in enumerate(rows)
                if row
            )
            archive.writestr(
                f"xl/worksheets/sheet{number}.xml",
                f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>',
            )
            entries.append(f'<sheet name={quoteattr(name)} sheetId="{number}" r:id="rId{number}"/>')
            links.append(
                f'<Relationship Id="rId{number}" Type="{DOCUMENT}/worksheet" '
                f'Target="worksheets/sheet{number}.xml"/>'
            )
        items = "".join(f"<si><t>{escape(text)}</t></si>" for text in strings)
        archive.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
        archive.writestr("xl/styles.xml", STYLES)
        archive.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{MAIN}" xmlns:r="{DOCUMENT}"><sheets>{"".join(entries)}'
            "</sheets></workbook>",
        )
        archive.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{PACKAGE}">{"".join(links)}</Relationships>',
        )
    return buffer.getvalue()

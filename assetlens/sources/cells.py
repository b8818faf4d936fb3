"""Cell values of one .xlsx worksheet as text; the per-file helper of the workbook job."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import cached_property, lru_cache
from typing import IO, Any
from xml.etree import ElementTree
from xml.parsers import expat

# The built-in number formats that show a date or a time.
DATE_FORMATS = set(range(14, 23)) | set(range(27, 37)) | {45, 47} | set(range(50, 59))
SECONDS_PER_DAY = 86_400
CHUNK_BYTES = 1 << 16


@lru_cache(maxsize=1024)
def local(name: str) -> str:
    """Element or attribute name without its namespace or prefix."""
    return name.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


@lru_cache(maxsize=20_000)
def column_index(letters: str) -> int:
    """0-based column of letters such as AB."""
    index = 0
    for letter in letters:
        index = index * 26 + ord(letter.upper()) - ord("A") + 1
    return index - 1


def parsed(
    stream: IO[bytes],
    start: Callable[[str, dict[str, str]], None],
    text: Callable[[str], None],
    end: Callable[[str], None],
    finished: list[Any],
) -> Iterator[Any]:
    """Feed a document to handlers, and give what they put into `finished` as it comes."""
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = start
    parser.CharacterDataHandler = text
    parser.EndElementHandler = end
    last = False
    while not last:
        chunk = stream.read(CHUNK_BYTES)
        last = not chunk
        parser.Parse(chunk, last)
        yield from finished
        finished.clear()


def shared_strings(stream: IO[bytes]) -> Iterator[str]:
    """String items in order: their runs joined, pronunciation hints left out."""
    finished: list[str] = []
    parts: list[str] = []
    inside: list[str] = []

    def start(name: str, _: dict[str, str]) -> None:
        inside.append(local(name))
        if inside[-1] == "si":
            parts.clear()

    def text(data: str) -> None:
        if inside and inside[-1] == "t" and "rPh" not in inside:
            parts.append(data)

    def end(_: str) -> None:
        if inside.pop() == "si":
            finished.append("".join(parts))

    return parsed(stream, start, text, end, finished)


class Workbook:
    """Directory, shared strings and date styles of an open workbook."""

    def __init__(self, file: IO[bytes]):
        self.archive = zipfile.ZipFile(file)
        self.members = set(self.archive.namelist())
        self.sheets: list[tuple[str, str]] = []
        self.epoch = datetime(1899, 12, 30)
        targets = {}
        for link in self._document("xl/_rels/workbook.xml.rels"):
            if (link.get("Type") or "").endswith("/worksheet"):
                target = link.get("Target") or ""
                targets[link.get("Id")] = (
                    target.lstrip("/") if target.startswith("/") else "xl/" + target
                )
        for element in self._document("xl/workbook.xml").iter():
            if local(element.tag) == "workbookPr" and element.get("date1904") in ("1", "true"):
                self.epoch = datetime(1904, 1, 1)
            elif local(element.tag) == "sheet":
                link = next((v for k, v in element.attrib.items() if local(k) == "id"), None)
                if link in targets:
                    self.sheets.append((element.get("name") or "", targets[link]))

    def _document(self, member: str) -> ElementTree.Element:
        with self.archive.open(member) as stream:
            return ElementTree.parse(stream).getroot()

    @cached_property
    def strings(self) -> list[str]:
        """Shared strings by index."""
        if "xl/sharedStrings.xml" not in self.members:
            return []
        with self.archive.open("xl/sharedStrings.xml") as stream:
            return list(shared_strings(stream))

    @cached_property
    def dates(self) -> set[str]:
        """Indexes of the cell styles that show dates."""
        if "xl/styles.xml" not in self.members:
            return set()
        return {str(index) for index in date_styles(self._document("xl/styles.xml"))}

    def rows(self, member: str) -> Iterator[tuple[int, list[str | None]]]:
        """Position and cells of every row down to the last one with a value.

        Rows that the file leaves out are given as blank ones, as a person would see them.
        """
        expected = 0
        with self.archive.open(member) as stream:
            for position, cells in self._filled_rows(stream):
                for blank in range(expected, position):
                    yield blank, []
                yield position, cells
                expected = position + 1

    def _filled_rows(self, stream: IO[bytes]) -> Iterator[tuple[int, list[str | None]]]:
        finished: list[tuple[int, list[str | None]]] = []
        cells: list[str | None] = []
        parts: list[str] = []
        position, column = -1, -1
        kind = style = None
        reading = hint = False

        def start(name: str, attributes: dict[str, str]) -> None:
            nonlocal position, column, kind, style, reading, hint
            tag = local(name)
            if tag == "c":
                reference = attributes.get("r")
                column = column_index(reference.rstrip("0123456789")) if reference else column + 1
                kind, style = attributes.get("t"), attributes.get("s")
                parts.clear()
            elif tag == "v" or tag == "t":
                reading = not hint
            elif tag == "row":
                position = int(attributes.get("r") or position + 2) - 1
                column = -1
                cells.clear()
            elif tag == "rPh":
                hint = True

        def text(data: str) -> None:
            if reading:
                parts.append(data)

        def end(name: str) -> None:
            nonlocal reading, hint
            tag = local(name)
            if tag == "v" or tag == "t":
                reading = False
            elif tag == "c":
                value = self._value(kind, style, "".join(parts)) if parts else None
                if value is not None:
                    cells.extend([None] * (column - len(cells)))
                    cells.append(value)
            elif tag == "row":
                if cells:
                    finished.append((position, cells.copy()))
            elif tag == "rPh":
                hint = False

        return parsed(stream, start, text, end, finished)

    def _value(self, kind: str | None, style: str | None, raw: str) -> str | None:
        if kind == "s":
            return self.strings[int(raw)] or None
        if kind == "inlineStr" or kind == "str":
            return raw
        if kind == "e":
            return None
        if kind == "b":
            return "True" if raw in ("1", "true") else "False"
        if kind == "d":
            return raw.replace("T", " ")
        if style is not None and style in self.dates:
            return moment_text(float(raw), self.epoch)
        if raw.isdecimal() and raw[0] != "0":
            return raw
        number = float(raw)
        return str(int(number)) if number.is_integer() else repr(number)


def date_styles(root: ElementTree.Element) -> set[int]:
    """Indexes of the cell formats whose number format is a date."""
    custom = {}
    styles: set[int] = set()
    for element in root.iter():
        if local(element.tag) == "numFmt":
            custom[int(element.get("numFmtId") or 0)] = element.get("formatCode") or ""
        elif local(element.tag) == "cellXfs":
            for index, style in enumerate(element):
                number = int(style.get("numFmtId") or 0)
                shown = custom.get(number)
                if number in DATE_FORMATS if shown is None else is_date_format(shown):
                    styles.add(index)
    return styles


def is_date_format(code: str) -> bool:
    """Whether a custom number format shows parts of a date or a time."""
    first = code.split(";", 1)[0]
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", first)
    return re.search("[dmhysDMHYS]", bare) is not None


@lru_cache(maxsize=100_000)
def moment_text(serial: float, epoch: datetime) -> str:
    """ISO text of a date serial; a serial below one is a time of day."""
    days, fraction = divmod(serial, 1)
    milliseconds = round(fraction * SECONDS_PER_DAY * 1000)
    if days == 0 and milliseconds < SECONDS_PER_DAY * 1000:
        return str((datetime.min + timedelta(milliseconds=milliseconds)).time())
    if epoch.year == 1899 and 0 < days < 60:
        days += 1  # the calendar of the file format has a 29 February 1900
    try:
        return str(epoch + timedelta(days=days, milliseconds=milliseconds))
    except OverflowError:
        return repr(serial)

"""Text of files by family, with the standard library: (inner, kind, size, modified, text) of each document.

A container gives one document for each entry.  Formats without a reader here are skipped with a
reason; so are damaged, encrypted and oversize files.  One bad file never fails a task.
"""

from __future__ import annotations

import bz2
import calendar
import email
import email.policy
import email.utils
import gzip
import io
import mailbox
import os
import re
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kinds import hidden_or_excluded, kind_of, kind_of_name

SEPARATOR = " › "
#: Limits of a file, an entry, a container, its entries, its depth, and its ratio above 1 MiB.
MAX_FILE, MAX_ENTRY, MAX_TOTAL, MAX_ENTRIES, MAX_DEPTH, MAX_RATIO, RATIO_FROM = 64 << 20, 64 << 20, 1 << 30, 20_000, 3, 100, 1 << 20
#: Reasons why a file has no text.
REASONS = ("unsupported", "unreadable", "corrupt", "encrypted", "too_large", "binary")
MARKERS = str.maketrans("", "", "⟦⟧⟪⟫")
MAX_CELLS = 2_000_000


class Skipped(Exception):
    """A file without text, and why."""


@dataclass
class Extracted:
    inner: str | None
    kind: str
    size: int | None
    modified: int | None
    text: str


def decode_text(data: bytes) -> str:
    """BOM, then NUL in the first 8 KiB means binary, then UTF-8, then a guess."""
    for bom, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(bom):
            return data[len(bom) :].decode(name, "replace")
    if b"\0" in data[:8192]:
        raise Skipped("binary")
    try:
        return data.decode()
    except UnicodeDecodeError:
        try:
            from charset_normalizer import from_bytes

            guess = from_bytes(data[:65536], cp_isolation=["cp1252", "cp1256", "iso8859_15"]).best()
            return data.decode(guess.encoding if guess else "cp1252", "replace")
        except ImportError:
            return data.decode("cp1252", "replace")


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise Skipped("encrypted" if data.startswith(b"\xd0\xcf\x11\xe0") else "corrupt") from None


def _part(archive: zipfile.ZipFile, name: str, most: int = 200 << 20) -> ElementTree.Element | None:
    try:
        info = archive.getinfo(name)
    except KeyError:
        return None
    if info.file_size > most:
        raise Skipped("too_large")
    try:
        return ElementTree.fromstring(archive.read(info))
    except (ElementTree.ParseError, zipfile.BadZipFile, RuntimeError):
        raise Skipped("corrupt") from None


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def docx_text(data: bytes) -> str:
    """A line for each paragraph; tabs and breaks as such."""
    root = _part(_zip(data), "word/document.xml")
    if root is None:
        raise Skipped("corrupt")
    lines = []
    for paragraph in (e for e in root.iter() if _local(e) == "p"):
        shown = {"tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n", "t": lambda e: e.text or ""}
        lines.append("".join(shown[_local(e)](e) for e in paragraph.iter() if _local(e) in shown))
    return "\n".join(lines)


def _by_number(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx_text(data: bytes) -> str:
    """``— N —`` blocks in the order of slides."""
    archive, out = _zip(data), []
    for i, name in enumerate(_by_number(archive.namelist(), r"ppt/slides/slide(\d+)\.xml"), 1):
        root = _part(archive, name)
        lines = ["".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in root.iter() if _local(p) == "p"]
        out.append("\n".join([f"— {i} —", *filter(None, lines)]))
    if not out:
        raise Skipped("corrupt")
    return "\n".join(out)


def _excel_date(serial: float) -> str:
    import datetime as dt

    moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=serial)
    return moment.date().isoformat() if serial == int(serial) else moment.replace(microsecond=0).isoformat(" ")


def _rows_text(title: str, rows: list[list[str]]) -> str:
    lines = [f"— {title} —"]
    for row in rows:
        while row and not row[-1]:
            row.pop()
        if row:
            lines.append("\t".join(row))
    return "\n".join(lines)


def xlsx_text(data: bytes) -> str:
    """``— sheet —`` and tab-joined rows without trailing empty cells; dates in ISO form."""
    archive = _zip(data)
    book, shared, styles = _part(archive, "xl/workbook.xml"), _part(archive, "xl/sharedStrings.xml"), _part(archive, "xl/styles.xml")
    if book is None:
        raise Skipped("corrupt")
    strings = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in (shared if shared is not None else [])]
    date_formats, formats = set(range(14, 23)) | set(range(45, 48)), []
    if styles is not None:
        for e in styles.iter():
            if _local(e) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "")), re.I):
                date_formats.add(int(e.get("numFmtId", 0)))
        formats = [int(x.get("numFmtId", 0)) for e in styles if _local(e) == "cellXfs" for x in e]
    relations = _part(archive, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target", "") for r in (relations if relations is not None else [])}
    out, cells = [], 0
    for sheet in (e for e in book.iter() if _local(e) == "sheet"):
        target = targets.get(_attribute(sheet, "id"), "")
        root = _part(archive, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        rows = []
        for row in (e for e in (root.iter() if root is not None else []) if _local(e) == "row"):
            values: list[str] = []
            for cell in (e for e in row if _local(e) == "c"):
                letters = re.match("[A-Z]+", cell.get("r", "")) or re.match("", "")
                column = 0
                for c in letters[0]:
                    column = column * 26 + ord(c) - 64
                values += [""] * max(0, column - 1 - len(values))
                raw = next((e.text or "" for e in cell if _local(e) == "v"), "")
                kind, style = cell.get("t"), int(cell.get("s", 0))
                if kind == "s":
                    raw = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in cell.iter() if _local(t) == "t")
                elif kind == "b":
                    raw = {"1": "TRUE", "0": "FALSE"}.get(raw, raw)
                elif raw and kind in (None, "n") and style < len(formats) and formats[style] in date_formats:
                    raw = _excel_date(float(raw))
                values.append(raw.replace("\n", " ").replace("\t", " "))
                cells += 1
                if cells > MAX_CELLS:
                    raise Skipped("too_large")
            rows.append(values)
        out.append(_rows_text(sheet.get("name", ""), rows))
    return "\n".join(out)


def ods_text(data: bytes) -> str:
    root = _part(_zip(data), "content.xml")
    if root is None:
        raise Skipped("corrupt")
    out = []
    for table in (e for e in root.iter() if _local(e) == "table"):
        rows = []
        for row in (e for e in table.iter() if _local(e) == "table-row"):
            values = []
            for cell in (e for e in row if _local(e) in ("table-cell", "covered-table-cell")):
                date = _attribute(cell, "date-value")
                shown = date.replace("T", " ") if date else " ".join("".join(p.itertext()) for p in cell if _local(p) == "p")
                values += [shown] * min(int(_attribute(cell, "number-columns-repeated") or 1), 64 if shown else 1)
            rows.append(values)
        out.append(_rows_text(_attribute(table, "name") or "", rows))
    return "\n".join(out)


def odf_text(data: bytes) -> str:
    """Lines of paragraphs and headings; ``— N —`` for each page of a presentation; notes are left out."""
    root = _part(_zip(data), "content.xml")
    if root is None:
        raise Skipped("corrupt")
    out, page = [], 0

    def inline(e) -> str:
        kind = _local(e)
        if kind in ("annotation", "note", "tracked-changes", "notes"):
            return e.tail or ""
        own = {"s": " " * min(int(_attribute(e, "c") or 1), 64), "tab": "\t", "line-break": "\n"}.get(kind, e.text or "")
        return own + "".join(inline(x) for x in e) + (e.tail or "")

    def walk(e) -> None:
        nonlocal page
        kind = _local(e)
        if kind in ("annotation", "note", "tracked-changes", "notes"):
            return
        if kind == "page":
            page += 1
            out.append(f"— {page} —")
        if kind in ("p", "h"):
            out.append((e.text or "") + "".join(inline(x) for x in e))
            return
        for child in e:
            walk(child)

    walk(root)
    return "\n".join(out)


class _Visible(HTMLParser):
    #: Elements that begin a line, and those whose text is hidden.
    BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "section"}
    HIDDEN = {"head", "script", "style"}

    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN
        if tag in self.BLOCKS or tag in ("br", "hr"):
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in ("br", "hr"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0
        if tag in ("td", "th"):
            self.out.append("\t")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(markup: str) -> str:
    parser = _Visible()
    parser.feed(markup)
    parser.close()
    return "\n".join(line.strip() for line in "".join(parser.out).splitlines() if line.strip())


def epub_text(data: bytes) -> str:
    """Chapters in the order of the spine."""
    archive = _zip(data)
    if "META-INF/encryption.xml" in archive.namelist():
        raise Skipped("encrypted")
    container = _part(archive, "META-INF/container.xml")
    root_file = next((_attribute(e, "full-path") for e in (container.iter() if container is not None else []) if _local(e) == "rootfile"), None)
    package = _part(archive, root_file) if root_file else None
    if package is None:
        raise Skipped("corrupt")
    items = {e.get("id"): e.get("href", "") for e in package.iter() if _local(e) == "item"}
    folder = root_file.rpartition("/")[0]
    chapters = []
    for ref in (e.get("idref") for e in package.iter() if _local(e) == "itemref"):
        name = "/".join(filter(None, [folder, unquote(items.get(ref, ""))]))
        if name in archive.namelist():
            chapters.append(html_text(archive.read(name).decode("utf-8", "replace")))
    return "\n".join(chapters)


#: RTF destinations that hold no text, and what some words mean.
RTF_SKIPPED = frozenset(
    "fonttbl colortbl stylesheet info pict object datastore themedata listtable listoverridetable rsidtbl generator latentstyles xmlnstbl mmathPr filetbl revtbl colorschememapping fldinst header footer "
    "headerl headerr footerl footerr wgrffmtfilter".split()
)
RTF_WORDS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
_RTF = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf_text(data: bytes) -> str:
    if not data.startswith(b"{\\rtf"):
        raise Skipped("corrupt")
    page, out, raw, stack, skip, fallback, eat = "cp1252", [], bytearray(), [], False, 1, 0

    def flush() -> None:
        if raw:
            out.append(bytes(raw).decode(page, "replace"))
            raw.clear()

    for m in _RTF.finditer(data):
        word, number, code, symbol, brace, plain = m.groups()
        if code is not None:
            if eat:
                eat -= 1
            elif not skip:
                raw.append(int(code, 16))
            continue
        flush()
        if brace == b"{":
            stack.append((skip, fallback))
            skip = skip or data[m.end() : m.end() + 2] == b"\\*"
        elif brace == b"}":
            skip, fallback = stack.pop() if stack else (skip, fallback)
            eat = 0
        elif word is not None:
            name = word.decode()
            if name in RTF_SKIPPED:
                skip = True
            elif name == "ansicpg" and number:
                try:
                    "".encode(f"cp{int(number)}")
                    page = f"cp{int(number)}"
                except LookupError:
                    pass
            elif name == "uc" and number:
                fallback = int(number)
            elif name == "bin" and number:
                skip = skip
            elif name == "u" and number and not skip:
                out.append(chr(int(number) % 65536))
                eat = fallback
            elif not skip:
                out.append(RTF_WORDS.get(name, ""))
        elif symbol is not None:
            if not skip:
                out.append({b"~": "\u00a0", b"_": "-", b"-": "", b"*": ""}.get(symbol, symbol.decode("latin-1")))
        elif plain is not None:
            shown = plain[eat:] if eat else plain
            eat = max(0, eat - len(plain))
            if not skip:
                raw += shown
    flush()
    joined = "".join(out)
    return joined.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_TEXT_READERS = {
    "docx": docx_text, "docm": docx_text, "odt": odf_text, "odp": odf_text, "rtf": rtf_text, "pptx": pptx_text, "pptm": pptx_text, "xlsx": xlsx_text, "xlsm": xlsx_text, "ods": ods_text, "epub": epub_text,
}


class _Budget:
    def __init__(self, family: str):
        self.family, self.bytes, self.entries, self.encrypted = family, 0, 0, 0

    def admits(self, name: str, size: int, packed: int | None) -> bool:
        """Whether an entry is of a known family and within all limits; counts it."""
        if kind_of_name(name.rpartition("/")[2]) is None or size > MAX_ENTRY or self.entries >= MAX_ENTRIES or self.bytes + size > MAX_TOTAL:
            return False
        if packed is not None and size > RATIO_FROM and size > MAX_RATIO * max(packed, 1):
            return False
        self.entries += 1
        self.bytes += size
        return True


def _entry(data: bytes, name: str, modified: int | None, prefix: str, depth: int, budget: _Budget) -> Iterator[Extracted]:
    kind, path = kind_of_name(name.rpartition("/")[2]), prefix + name
    try:
        if kind == "archive":
            if depth + 1 < MAX_DEPTH:
                yield from _archive(data, name, path + SEPARATOR, depth + 1, budget)
            return
        for doc in extract(data, name):
            yield Extracted(path if doc.inner is None else path + SEPARATOR + doc.inner, budget.family, len(data), modified if modified is not None else doc.modified, doc.text)
    except Skipped:
        return


def _archive(data: bytes, name: str, prefix: str, depth: int, budget: _Budget) -> Iterator[Extracted]:
    lower = name.lower()
    if lower.endswith((".zip", ".jar")):
        for info in (archive := _zip(data)).infolist():
            if info.flag_bits & 1:
                budget.encrypted += 1
            elif not info.is_dir() and budget.admits(info.filename, info.file_size, info.compress_size):
                try:
                    content = archive.read(info)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, OSError):
                    continue
                yield from _entry(content, info.filename.replace("\\", "/"), calendar.timegm((*info.date_time, 0, 0, 0)), prefix, depth, budget)
    elif re.search(r"\.(tar|tar\.gz|tgz|tar\.bz2|tbz2|tbz)$", lower):
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                for member in archive:
                    if member.isfile() and budget.admits(member.name, member.size, None):
                        yield from _entry(archive.extractfile(member).read(), member.name.replace("\\", "/"), int(member.mtime), prefix, depth, budget)
        except (tarfile.TarError, EOFError, OSError):
            if not budget.entries:
                raise Skipped("corrupt") from None
    elif lower.endswith((".gz", ".bz2")):
        try:
            stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if lower.endswith(".gz") else bz2.BZ2File(io.BytesIO(data))
            content = stream.read(MAX_ENTRY + 1)
        except (OSError, EOFError):
            raise Skipped("corrupt") from None
        inner = re.split(r"[/\\]", name)[-1].rpartition(".")[0]
        if budget.admits(inner, len(content), len(data)):
            yield from _entry(content, inner, None, prefix, depth, budget)
    else:
        raise Skipped("unsupported")


def _attachment_name(name: str) -> str:
    return re.sub(r"[/\\]", "_", name).replace(SEPARATOR, " - ")


def _message(message: email.message.EmailMessage, prefix: str = "") -> Iterator[Extracted]:
    """The message, then a document for each of its attachments."""
    date = email.utils.parsedate_tz(message.get("date", ""))
    modified = int(email.utils.mktime_tz(date)) if date else None
    body = message.get_body(("plain",)) or message.get_body(("html",))
    try:
        text = body.get_content() if body is not None else ""
    except (LookupError, KeyError, UnicodeError):
        text = (body.get_payload(decode=True) or b"").decode("latin-1")
    if body is not None and body.get_content_type() == "text/html":
        text = html_text(text)
    parts = []
    for part in message.iter_attachments():
        name = part.get_filename()
        if part.get_content_type() == "message/rfc822":
            inner = part.get_content()
            name = name or f"{inner.get('subject', 'message')}.eml"
            data = inner.as_bytes()
        else:
            data = part.get_payload(decode=True) or b""
        if name:
            parts.append((_attachment_name(name), data))
    head = [str(message.get(k, "")) for k in ("subject", "from", "to", "cc")]
    lines = [*filter(None, head), "", text.strip(), *[f"📎 {n}" for n, _ in parts]]
    yield Extracted(prefix or None, "email", None, modified, "\n".join(lines))
    budget = _Budget("email")
    for name, data in parts:
        if budget.admits(name, len(data), None):
            yield from _entry(data, name, modified, prefix + SEPARATOR if prefix else "", 0, budget)


def _mbox(data: bytes) -> Iterator[Extracted]:
    """Messages by cleaned subject; repeated subjects get a number."""
    seen: dict[str, int] = {}
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "m")
        with open(path, "wb") as f:
            f.write(data)
        box = mailbox.mbox(path)
        for key in box.keys():
            raw = box.get_bytes(key)
            if len(raw) > MAX_ENTRY:
                continue
            message = email.message_from_bytes(raw, policy=email.policy.default)
            name = _attachment_name(re.sub(r"\s+", " ", str(message.get("subject", ""))).strip()) or "—"
            seen[name] = seen.get(name, 0) + 1
            yield from _message(message, name if seen[name] == 1 else f"{name} ({seen[name]})")
        box.close()
    if not seen:
        raise Skipped("corrupt")


def extract(data: bytes, name: str) -> Iterator[Extracted]:
    """The documents of one file; raises :class:`Skipped`."""
    kind, ext = kind_of_name(name.rpartition("/")[2]), name.lower().rpartition(".")[2]
    if kind is None:
        raise Skipped("unsupported")
    if len(data) > MAX_FILE and kind != "archive":
        raise Skipped("too_large")
    if kind == "archive":
        budget = _Budget("archive")
        docs = list(_archive(data, name, "", 0, budget))
        if not docs and budget.encrypted:
            raise Skipped("encrypted")
        yield from docs
    elif ext == "eml":
        yield from _message(email.message_from_bytes(data, policy=email.policy.default))
    elif ext == "mbox":
        yield from _mbox(data)
    elif ext in _TEXT_READERS:
        yield Extracted(None, kind, len(data), None, _TEXT_READERS[ext](data).translate(MARKERS))
    elif kind in ("text", "code"):
        yield Extracted(None, kind, len(data), None, decode_text(data).translate(MARKERS))
    else:
        raise Skipped("unsupported")


def extract_raw(data: bytes, name: str, inner: str) -> bytes | None:
    """The bytes of a first-level entry of a ZIP or TAR archive, or of an e-mail's attachment."""
    lower = name.lower()
    if lower.endswith((".zip", ".jar")):
        archive = _zip(data)
        return archive.read(inner) if inner in archive.namelist() else None
    if re.search(r"\.(tar|tar\.gz|tgz|tar\.bz2|tbz2|tbz)$", lower):
        with tarfile.open(fileobj=io.BytesIO(data)) as archive:
            return next((archive.extractfile(m).read() for m in archive if m.isfile() and m.name == inner), None)
    if lower.endswith(".eml"):
        message = email.message_from_bytes(data, policy=email.policy.default)
        return next((p.get_payload(decode=True) for p in message.iter_attachments() if p.get_filename() and _attachment_name(p.get_filename()) == inner), None)
    return None


SCHEMA = "path string, inner string, kind string, size long, modified long, text string, skipped string"


def _extract_batches(batches):
    for pdf in batches:
        rows = []
        for path, data in zip(pdf["path"], pdf["content"]):
            name = unquote(path.rpartition("/")[2]) if path.startswith("file:") else path.rpartition("/")[2]
            try:
                rows += [(path, d.inner, d.kind, d.size, d.modified, d.text, None) for d in extract(bytes(data), name)]
            except Skipped as why:
                rows.append((path, None, kind_of_name(name), len(data), None, None, str(why)))
            except Exception:  # a damaged file must not fail the task
                rows.append((path, None, kind_of_name(name), len(data), None, None, "corrupt"))
        yield pd.DataFrame(rows, columns=["path", "inner", "kind", "size", "modified", "text", "skipped"])


def crawl(spark: SparkSession, root: str, exclusions: list[str] | None = None) -> DataFrame:
    """(path, kind, size, modified) of readable files below a root; contents are not read.

    Hidden and excluded folders and unknown families are left out.
    """
    from .kinds import excluded

    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", "^[a-z0-9]+:(//)?", "")
    relative = F.substring(below, F.locate(base, below) + len(base), 2**31 - 1)
    rows = files.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified"), relative.alias("relative"))
    rows = rows.withColumn("kind", kind_of(F.col("path"))).where(F.col("kind").isNotNull() & ~hidden_or_excluded(F.col("relative")))
    return rows.where(~excluded(F.col("relative"), exclusions or []))


#: Up to so many wanted files are opened by name; of more, the whole folder is read and the others dropped.
NAMED_FILES = 10_000


def extract_files(spark: SparkSession, root: str, exclusions: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """The documents of every readable file below a root, or of those of ``only(path)``; a skipped file has one row with its reason."""
    wanted = crawl(spark, root, exclusions).select("path") if only is None else only.select("path")
    named = [] if only is None else [re.sub(r"([\[\]{}*?,\\])", r"\\\1", r["path"]) for r in wanted.limit(NAMED_FILES + 1).collect()]  # names are not patterns
    if only is not None and not named:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(named if 0 < len(named) <= NAMED_FILES else root).select("path", "content")
    return files.join(wanted, "path", "left_semi").mapInPandas(_extract_batches, SCHEMA)

"""Documents to paragraphs to chunks: sequential parsers, run once per file inside an Arrow map.

A paragraph is (type, content, line, level) with type heading, paragraph, code or list.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.paths import MARKDOWN
from foliant.scale import ship

PARAGRAPHS = "array<struct<type:string,content:string,line:int,level:int>>"
CHUNK = "chunk_id string, file_path string, file_name string, title string, content string, start_line int, end_line int, chunk_index int, total_chunks int, section_index int, sub_index int, has_heading boolean"


@dataclass(frozen=True)
class Paragraph:
    type: str
    content: str
    line: int
    level: int = 0


def parse_markdown(text: str) -> list[Paragraph]:
    """Fences, headings (any leading ``#``), list lines, and paragraphs up to a blank line; an open fence ends with the text."""
    out: list[Paragraph] = []
    held: list[str] = []
    begin, fence = 0, False

    def flush(kind: str = "paragraph") -> None:
        if held and "\n".join(held).strip():
            out.append(Paragraph(kind, "\n".join(held), begin))
        held.clear()

    for at, line in enumerate(text.split("\n")):
        bare = line.strip()
        if fence or bare.startswith("```"):
            if not fence:
                flush()
                begin = at
            held.append(line)
            if fence and bare.startswith("```"):
                flush("code")
                fence = False
            else:
                fence = True
        elif bare.startswith("#"):
            flush()
            level = len(bare) - len(bare.lstrip("#"))
            out.append(Paragraph("heading", bare.lstrip("#").strip(), at, level))
        elif re.match(r"[-*+]|\d+\.", bare):
            flush()
            out.append(Paragraph("list", bare, at))
        elif not bare:
            flush()
        else:
            begin = begin if held else at
            held.append(line)
    flush("code" if fence else "paragraph")
    return out


def parse_text(text: str) -> list[Paragraph]:
    """Blank-line separated blocks of stripped lines."""
    out, held, begin = [], [], 0
    for at, line in enumerate([*text.split("\n"), ""]):
        if line.strip():
            begin = begin if held else at
            held.append(line.strip())
        elif held:
            out.append(Paragraph("paragraph", "\n".join(held), begin))
            held = []
    return out


class _Html(HTMLParser):
    """Text of each block element, nested ones included again in their container."""

    SKIP = frozenset(("script", "style", "nav", "footer", "header"))
    HEADINGS = {f"h{i}": i for i in range(1, 7)}
    BLOCKS = frozenset(("p", "li", "div", "article", "section", "pre", *HEADINGS))
    CLOSES = {"p": ("p",), "li": ("li", "p"), **{h: ("p",) for h in HEADINGS}, "div": ("p",), "article": ("p",), "section": ("p",), "pre": ("p",)}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.order, self.open = 0, 0, []
        self.found: list[tuple[int, str, str]] = []
        self.body: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif not self.skip and tag in self.BLOCKS:
            if self.open and self.open[-1][1] in self.CLOSES.get(tag, ()):
                self._end()
            self.open.append((self.order, tag, []))
            self.order += 1

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and any(t == tag for _, t, _ in self.open):
            while self.open[-1][1] != tag:
                self._end()
            self._end()

    def handle_data(self, data):
        if not self.skip:
            self.body.append(data)
            for _, _, parts in self.open:
                parts.append(data)

    def _end(self):
        order, tag, parts = self.open.pop()
        text = "".join(parts) if tag == "pre" else " ".join("".join(parts).split())
        self.found.append((order, tag, text.strip()))

    def finish(self) -> list[Paragraph]:
        self.close()
        while self.open:
            self._end()
        out, count = [], 0
        for _, tag, text in sorted(self.found):
            if not text:
                continue
            if tag in self.HEADINGS:
                out.append(Paragraph("heading", text, count, self.HEADINGS[tag]))
            elif tag == "pre":
                out.append(Paragraph("code", text, count))
            elif len(text) > 10:
                out.append(Paragraph("list" if tag == "li" else "paragraph", text, count))
            count += 1
        if not out:
            out = [Paragraph("paragraph", x.strip(), i) for i, x in enumerate("".join(self.body).split("\n")) if x.strip()]
        return out


def parse_html(text: str) -> list[Paragraph]:
    p = _Html()
    p.feed(text)
    return p.finish()


def parse_docx(content: bytes) -> list[Paragraph]:
    """Non-empty paragraphs of a Word document; heading styles become headings."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for i, p in enumerate(root.iter(f"{w}p")):
        text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
        style = next((s.get(f"{w}val", "") for s in p.iter(f"{w}pStyle")), "")
        level = re.fullmatch(r"[Hh]eading ?(\d)", style)
        if text:
            out.append(Paragraph("heading", text, i, int(level[1])) if level else Paragraph("paragraph", text, i))
    return out


def parse_pdf(content: bytes) -> list[Paragraph]:
    """Text blocks of a PDF, where a PDF library is installed."""
    try:
        import fitz
    except ModuleNotFoundError as e:
        raise ValueError("unsupported: reading PDF needs a PDF library") from e
    out = []
    with fitz.open(stream=content, filetype="pdf") as pdf:
        for page in pdf:
            out += [b[4].strip() for b in page.get_text("blocks") if b[4].strip()]
    return [Paragraph("paragraph", t, i) for i, t in enumerate(out)]


def parse_file(extension: str, content: bytes) -> list[Paragraph]:
    """By extension, in any case; what is neither Markdown, text, PDF nor Word is read as HTML."""
    ext = extension.lower()
    if ext == ".pdf":
        return parse_pdf(content)
    if ext == ".docx":
        return parse_docx(content)
    text = content.decode("utf-8", "ignore")
    return parse_markdown(text) if ext in MARKDOWN else parse_text(text) if ext == ".txt" else parse_html(text)


@dataclass(frozen=True)
class ChunkConfig:
    max_size: int = 800
    overlap: int = 100


#: A heading of this level or higher up opens a section.
SECTION_LEVEL = 3


def sections(paragraphs: list[Paragraph]) -> list[list[Paragraph]]:
    """Groups that a heading of level 1 to 3 opens; what comes before the first one is a group of its own."""
    out: list[list[Paragraph]] = []
    for p in paragraphs:
        if not out or p.type == "heading" and p.level <= SECTION_LEVEL:
            out.append([])
        out[-1].append(p)
    return out


def overlap(parts: list[str], size: int) -> str:
    text = "\n".join(parts)
    if len(text) <= size:
        return text
    tail = text[-size:] if size else ""
    cut = tail.find("\n")
    return tail[cut + 1 :] if cut > 0 else tail


def split_section(paragraphs: list[Paragraph], config: ChunkConfig) -> Iterator[tuple[str, int, int]]:
    """(content, first line, last line) of chunks up to max_size; paragraphs stay whole, chunks overlap."""
    held: list[str] = []
    begin, size, last = (paragraphs[0].line if paragraphs else 0), 0, 0
    for p in paragraphs:
        if not p.content.strip():
            continue
        if held and size + len(p.content) > config.max_size:
            yield "\n\n".join(held), begin, p.line
            tail = overlap(held, config.overlap)
            held, begin, size = ([tail] if tail else []), p.line, len(tail)
        held.append(p.content)
        size += len(p.content)
        last = p.line
    if held:
        yield "\n\n".join(held), begin, last


def chunk(path: str, name: str, title: str, paragraphs: list[Paragraph], config: ChunkConfig = ChunkConfig()) -> list[dict]:
    out = []
    for s, group in enumerate(sections(paragraphs)):
        for k, (content, a, b) in enumerate(split_section(group, config)):
            out.append({"chunk_id": f"{path}:{a}:{s}:{k}", "file_path": path, "file_name": name, "title": title, "content": content, "start_line": a, "end_line": b, "chunk_index": len(out), "section_index": s, "sub_index": k, "has_heading": True})
    return [{**c, "total_chunks": len(out)} for c in out]


def title_of(text: Column, ext: Column, name: Column) -> Column:
    """Markdown: the first ``# `` line of the first 20; HTML: title, then h1; text: the first line of the first 10, 80 characters."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    head = F.get(F.filter(F.slice(lines, 1, 20), lambda x: F.trim(x).startswith("# ")), F.lit(0))
    page = F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(text, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), "<[^>]*>", ""), r"\s+", " ")), F.lit("")) for t in ("title", "h1")])
    plain = F.substring(F.trim(F.get(F.filter(F.slice(lines, 1, 10), lambda x: F.length(F.trim(x)) > 0), F.lit(0))), 1, 80)
    found = F.when(ext.isin(*MARKDOWN), F.trim(F.substring(F.trim(head), 3, 1 << 20))).when(ext == ".txt", plain).when(~ext.isin(".pdf", ".docx"), page)
    return F.coalesce(F.nullif(found, F.lit("")), name)


#: Characters of chunks, or files, after which a map gives its rows on.
OUT_CHARS, OUT_FILES = 1 << 22, 256


def _map_files(config: ChunkConfig, keep: tuple[str, ...]):
    """Rows (keep, error, chunks) of rows (keep, file_path, file_name, file_extension, title, content, read_error)."""

    def run(batches):
        for b in batches:
            at, size, done, errors = 0, 0, [], []
            for i in range(b.num_rows):
                r = {c: b[c][i].as_py() for c in ("file_path", "file_name", "file_extension", "title", "content", "read_error")}
                try:
                    rows, error = ([], r["read_error"]) if r["read_error"] else (chunk(r["file_path"], r["file_name"], r["title"], parse_file(r["file_extension"], r["content"] or b""), config), None)
                except Exception as e:  # a bad file must not stop the others; the caller gets its message
                    rows, error = [], f"{type(e).__name__}: {e}"
                done.append(rows)
                errors.append(error)
                size += sum(len(c["content"]) for c in rows)
                if size > OUT_CHARS or len(done) >= OUT_FILES or i == b.num_rows - 1:
                    kept = b.slice(at, len(done))
                    yield pa.RecordBatch.from_arrays([*(kept[c] for c in keep), pa.array(errors, pa.string()), pa.array(done, _CHUNKS)], names=[*keep, "error", "chunks"])
                    at, size, done, errors = i + 1, 0, [], []

    return run


_CHUNKS = pa.list_(pa.struct([(k, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for k, t in (c.split() for c in CHUNK.split(", "))]))


def chunk_files(files: DataFrame, config: ChunkConfig = ChunkConfig(), keep: tuple[str, ...] = ("file_path",)) -> DataFrame:
    """(keep, error, chunks) of files with content; one bad file gives an error row, and so does one with a ``read_error``."""
    ship(files.sparkSession)
    inner = ",".join(f"{k}:{t}" for k, t in (c.split() for c in CHUNK.split(", ")))
    files = files if "read_error" in files.columns else files.withColumn("read_error", F.lit(None).cast("string"))
    needed = dict.fromkeys((*keep, "file_path", "file_name", "file_extension", "title", "content", "read_error"))
    kept = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*needed).mapInArrow(_map_files(config, tuple(keep)), f"{kept}, error string, chunks array<struct<{inner}>>")


def explode_chunks(done: DataFrame) -> DataFrame:
    return done.select(F.explode("chunks").alias("c")).select("c.*")


_PARAGRAPHS = pa.list_(pa.struct([("type", pa.string()), ("content", pa.string()), ("line", pa.int32()), ("level", pa.int32())]))


def paragraph_array(parsed: list[list[Paragraph]]) -> pa.Array:
    return pa.array([[{"type": p.type, "content": p.content, "line": p.line, "level": p.level} for p in ps] for ps in parsed], _PARAGRAPHS)


def section_ids(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` (id, pos, type, level, ...) with section: which of the groups of ``sections`` each belongs to, from 0."""
    order = Window.partitionBy("id").orderBy("pos")
    opens = ((F.col("type") == "heading") & (F.col("level") <= SECTION_LEVEL)) | (F.row_number().over(order) == 1)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return paragraphs.withColumn("__opens", opens.cast("int")).withColumn("section", F.sum("__opens").over(running) - 1).drop("__opens")


def paragraphs_of(texts: DataFrame, kind: str) -> DataFrame:
    """(id, text) -> (id, pos, type, content, line, level) by the parser ``kind``: markdown, html or text."""
    ship(texts.sparkSession)
    parser = {"markdown": parse_markdown, "html": parse_html, "text": parse_text}[kind]

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ps = parser(t or "")
                cols = [pa.array([k] * len(ps), pa.string()), pa.array(range(len(ps)), pa.int32()), *[pa.array([getattr(p, f) for p in ps], t) for f, t in (("type", pa.string()), ("content", pa.string()), ("line", pa.int32()), ("level", pa.int32()))]]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "pos", "type", "content", "line", "level"])

    return texts.mapInArrow(run, "id string, pos int, type string, content string, line int, level int")

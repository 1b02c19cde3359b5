"""TeX archives and documents from files: format by first bytes, members within bounds, root file, inlined parts, text."""

from __future__ import annotations

import bz2
import gzip
import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.latex import tex_to_text

# Bounds of an archive.
MAX_FILES, MAX_TOTAL, MAX_TEX, MAX_IMAGE = 4000, 80 << 20, 8 << 20, 24 << 20
TEX_NAMES, IMAGE_NAMES = (".tex", ".ltx"), (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".avif", ".pdf", ".eps", ".ps")
PREFERRED = ("main.tex", "paper.tex", "manuscript.tex", "ms.tex", "arxiv.tex")


def archive_format(content: Column) -> Column:
    """zip, tar.gz, tar.bz2, tar or '' by magic bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.isin("504B0304", "504B0506"), "zip").when(head.startswith("1F8B"), "tar.gz").when(head.startswith("425A68"), "tar.bz2").when(F.substring(content, 258, 5) == F.lit(b"ustar"), "tar").otherwise("")


def format_of(data: bytes) -> str:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "tar.gz"
    if data[:3] == b"BZh":
        return "tar.bz2"
    return "tar" if data[257:262] == b"ustar" else ""


def decode(raw: bytes) -> str:
    """UTF-8 without its mark, else Latin-1; one kind of line end."""
    raw = raw.removeprefix(b"\xef\xbb\xbf")
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Text and image members by safe relative path, within the bounds; a broken archive ends where it breaks."""
    kind, total, seen = format_of(data), 0, 0

    def entries() -> Iterator[tuple[str, int, object]]:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, i.file_size, lambda i=i: z.read(i)
        elif kind:
            raw = gzip.decompress(data) if kind == "tar.gz" else bz2.decompress(data) if kind == "tar.bz2" else data
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                for i in t:
                    if i.isfile():
                        yield i.name, i.size, lambda i=i: t.extractfile(i).read()

    try:
        for name, size, read in entries():
            seen += 1
            path = name.replace("\\", "/").lstrip("/")
            if seen > MAX_FILES:
                return
            is_tex, is_image = path.lower().endswith(TEX_NAMES), path.lower().endswith(IMAGE_NAMES)
            if ".." in path.split("/") or not (is_tex or is_image) or size > (MAX_TEX if is_tex else MAX_IMAGE):
                continue
            total += size
            if total > MAX_TOTAL:
                return
            yield path.removeprefix("./"), read()
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError):
        return


def main_file(files: dict[str, str]) -> str:
    """By document class, preferred name, begun document, then length; the first listed of equals."""
    order = lambda p: (not re.search(r"\\documentclass\b", files[p]), posixpath.basename(p).lower() not in PREFERRED, r"\begin{document}" not in files[p], -len(files[p].encode()))
    return min(files, key=order, default="")


def resolve(start: str, target: str, files: dict[str, object]) -> str:
    """The file an inclusion means: as written, beside the including file, with an extension added, else by base name."""
    clean = target.strip().replace("\\", "/").lstrip("./")
    if not clean:
        return ""
    folder = posixpath.dirname(start).strip("/")
    asked = [clean, *([f"{folder}/{clean}"] if folder not in ("", ".") else [])]
    asked = [x for a in asked for x in ((a,) if a.lower().endswith(TEX_NAMES) else (a, a + ".tex", a + ".ltx"))]
    for a in asked:
        if a in files:
            return a
    return next((f for f in files if posixpath.basename(f).lower() == asked[-1].lower()), "")


def inline(text: str, start: str, files: dict[str, str], seen: frozenset[str] = frozenset()) -> str:
    """Inclusions replaced by their files, each path entered once."""
    seen = seen | {start}

    def part(m: re.Match) -> str:
        found = resolve(start, m[1], files)
        return "" if not found or found in seen else "\n" + inline(files[found], found, files, seen) + "\n"

    return re.sub(r"\\(?:input|include|subfile)\s*\{([^}]+)\}", part, text)


def find_image(start: str, target: str, images: dict[str, object]) -> str:
    """The image a command means: as written, beside the file, with a known extension, else by base name in any case."""
    clean = target.strip().replace("\\", "/").lstrip("./")
    if not clean:
        return ""
    folder = posixpath.dirname(start).strip("/")
    bases = [clean, *([f"{folder}/{clean}"] if folder not in ("", ".") else [])]
    bare = not posixpath.splitext(clean)[1]
    for base in bases:
        for name in (base, *([base + x for x in IMAGE_NAMES] if bare else [])):
            if name in images:
                return name
    wanted = posixpath.basename(clean).lower()
    return next((i for i in images if (posixpath.splitext(posixpath.basename(i).lower())[0] if bare else posixpath.basename(i).lower()) == wanted), "")


_FIGURES = ("figure", "figure*", "wrapfigure", "sidewaysfigure", "SCfigure", "subfigure", "minipage")
_GRAPHICS = re.compile(r"\\includegraphics(?:\s*\[[^\]]*\])?\s*\{([^}]+)\}")
_CAPTION = re.compile(r"\\caption(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}")


def substitute_figures(tex: str, main: str, images: dict[str, object], base: str = "") -> str:
    """Figures as image lines with their captions; images that are not there leave the caption alone. Without images nothing changes."""
    if not images:
        return tex

    def picture(path: str, caption: str) -> str:
        found = find_image(main, path, images)
        if not found:
            return ""
        label = re.sub(r"[\r\n\[\]]+", " ", caption).strip() or posixpath.basename(found)
        return f"[Figure: {label}]({base}{found})" if found.lower().endswith((".pdf", ".eps", ".ps")) else f"![{label}]({base}{found})"

    def block(m: re.Match) -> str:
        caption = " / ".join(c for c in (tex_to_text(x) for x in _CAPTION.findall(m[1])) if c)
        lines = [p for p in (picture(x, caption) for x in _GRAPHICS.findall(m[1])) if p]
        if not lines:
            return f"\n\nFigure: {caption}\n\n" if caption else "\n\n"
        return "\n\n" + "\n\n".join(lines) + "\n\n" + (f"Caption: {caption}\n\n" if caption else "")

    for name in _FIGURES:
        tex = re.sub(rf"\\begin\{{{re.escape(name)}\}}(?:\[[^\]]*\])?(?:\{{[^}}]*\}})?(.*?)\\end\{{{re.escape(name)}\}}", block, tex, flags=re.DOTALL)
    return _GRAPHICS.sub(lambda m: f"\n\n{p}\n\n" if (p := picture(m[1], "")) else "", tex)


def archive_text(data: bytes) -> tuple[str, str]:
    """Main file and text of an archive, both '' without TeX files."""
    parts = dict(members(data))
    files = {p: decode(b) for p, b in parts.items() if p.lower().endswith(TEX_NAMES)}
    if not files:
        return "", ""
    main = main_file(files)
    return main, tex_to_text(substitute_figures(inline(files[main], main, files), main, {p: b for p, b in parts.items() if p not in files}))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(p, format_of(bytes(c)), *archive_text(bytes(c))) for p, c in zip(frame["path"], frame["content"], strict=True)]
        yield pd.DataFrame(rows, columns=["path", "format", "main_file", "text"])


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, format, main_file, text of each archive in a folder; an archive is one row and bounded by MAX_TOTAL."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return files.mapInPandas(_read, "path string, format string, main_file string, text string")


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text of pasted or dropped files."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def pages_of_scan(text: str | Column) -> Column:
    """Pages of a scanned document, which are joined by form feeds."""
    return F.split(F.col(text) if isinstance(text, str) else text, "\f")


def find_pdf(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The first file of a key's folder, small letters before capitals in the extension, by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF}").load(f"{folder}/{key}").select("path")
    return files.orderBy(F.when(F.col("path").endswith(".pdf"), 0).otherwise(1), "path").limit(1)

"""Files as documents: a recursive scan with its filters, and the texts hidden in images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftspark.operators.text import path_kind

# Fixed values of the scan: size limit, directories left out, bytes looked at for zeros, bytes a compressed text of an image may grow to.
MOST_BYTES, SNIFFED, IMAGE_TEXT = 2 << 20, 8192, 1 << 20
SKIPPED = (".git", ".hg", ".idea", ".svn", ".venv", ".vscode", "__pycache__", "build", "dist", "node_modules", "target", "vendor", "venv")


def files(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Documents of a directory: source (path under root), kind, content, priority.

    Files over the limit aren't read (the filter on length is pushed into the scan); those
    under a skipped directory and binary ones of no other kind are left out. Instruction and configuration files come first.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    small = read.where(F.col("length") <= most_bytes).select(F.regexp_replace(F.regexp_replace("path", "^file:/+", "file:/"), "^" + prefix.replace("file://", "file:"), "").alias("source"), "content")
    folders = F.slice(F.split("source", "/"), 1, F.size(F.split("source", "/")) - 1)
    kept = small.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED)))).withColumn("kind", path_kind(F.col("source")))
    binary = F.instr(F.decode(F.substring("content", 1, SNIFFED), "ISO-8859-1"), "\0") > 0
    return kept.where((F.col("kind") != "file") | ~binary).withColumn("priority", F.when(F.col("kind").isin("instructions", "agent_config"), 0).otherwise(1))


def single_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as it was asked for: source, kind, content, priority. Neither its size, its folder nor its bytes leave it out."""
    read = spark.read.format("binaryFile").load(path).select(F.lit(path.rsplit("/", 1)[-1]).alias("source"), "content")
    return read.withColumn("kind", path_kind(F.col("source"))).withColumn("priority", F.when(F.col("kind").isin("instructions", "agent_config"), 0).otherwise(1)).select("source", "kind", "content", "priority")


def left_out(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """source and length of the files of a directory that are over the limit, which the scan doesn't read: what it says nothing about."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") > most_bytes)
    return listed.select(F.col("path").alias("source"), "length")


def file_documents(read: DataFrame, ocr: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """Files (of :func:`files` or :func:`single_file`) as documents with their text, instructions and configuration first, then by name: source, kind, raw.

    Images give the text of their metadata, and what ``ocr`` reads in them after it, as ``ocr: `` and its text; without it none is read.
    """
    image = F.when(F.col("kind") == "image", F.col("content"))
    text = image_text(image) if ocr is None else _with_ocr(ocr)(image)
    return read.orderBy("priority", "source").select("source", "kind", F.when(F.col("kind") == "image", text).otherwise(F.decode("content", "UTF-8")).alias("raw"))


def _with_ocr(ocr: Callable[[bytes], str | None]):
    @F.arrow_udf(StringType())
    def run(contents: pa.Array) -> pa.Array:
        out = []
        for c in contents.to_pylist():
            parts = [metadata_text(c), ocr(c) if c else None]
            shown = "\nocr: ".join(p or "" for p in parts) if parts[1] else parts[0]
            out.append(shown)
        return pa.array(out, pa.string())

    return run


def _inflated(data: bytes) -> bytes:
    """A compressed text; one that grows over the limit is cut there, and says so."""
    unpack = zlib.decompressobj()
    out = unpack.decompress(data, IMAGE_TEXT)
    return out + b"\n[cut at the limit]" if unpack.unconsumed_tail else out


def metadata_text(content: bytes | None) -> str | None:
    """Text in an image's metadata: PNG text chunks, JPEG comments and application segments, GIF comments, WebP EXIF and XMP, SVG as it is. Null if there is none."""
    if not content:
        return None
    out: list[str] = []
    try:
        if content.startswith(b"\x89PNG\r\n\x1a\n"):
            _png(content, out)
        elif content.startswith(b"\xff\xd8"):
            _jpeg(content, out)
        elif content[:6] in (b"GIF87a", b"GIF89a"):
            _gif(content, out)
        elif content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            _webp(content, out)
        elif b"<svg" in content.lower():
            out.append(content.decode("utf-8", "replace"))
    except (struct.error, IndexError, zlib.error):
        pass  # what was read before the damage counts
    text = "\n".join(t for t in out if t.strip())
    return text or None


def _png(b: bytes, out: list[str]) -> None:
    at = 8
    while at + 8 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        data = b[at + 8 : at + 8 + size]
        if kind == b"tEXt":
            out.append(data.partition(b"\0")[2].decode("latin-1"))
        elif kind == b"zTXt":
            out.append(_inflated(data.partition(b"\0")[2][1:]).decode("latin-1"))
        elif kind == b"iTXt":
            _, _, rest = data.partition(b"\0")
            packed, rest = rest[0], rest[2:]
            rest = rest.split(b"\0", 2)[2]
            out.append((_inflated(rest) if packed else rest).decode("utf-8", "replace"))
        at += 12 + size


def _jpeg(b: bytes, out: list[str]) -> None:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] != 0xDA:
        size = struct.unpack(">H", b[at + 2 : at + 4])[0]
        data = b[at + 4 : at + 2 + size]
        if b[at + 1] == 0xFE:
            out.append(data.decode("utf-8", "replace"))
        elif 0xE0 <= b[at + 1] <= 0xEF:
            out.extend(_runs(data))
        at += 2 + size


def _gif(b: bytes, out: list[str]) -> None:
    at = b.find(b"\x21\xfe")
    while at >= 0:
        i, parts = at + 2, []
        while i < len(b) and b[i]:
            parts.append(b[i + 1 : i + 1 + b[i]])
            i += 1 + b[i]
        out.append(b"".join(parts).decode("utf-8", "replace"))
        at = b.find(b"\x21\xfe", i)


def _webp(b: bytes, out: list[str]) -> None:
    at = 12
    while at + 8 <= len(b):
        kind, size = b[at : at + 4], struct.unpack("<I", b[at + 4 : at + 8])[0]
        if kind in (b"EXIF", b"XMP "):
            out.extend(_runs(b[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2


def _runs(data: bytes) -> list[str]:
    """Runs of eight or more printable ASCII characters."""
    out, run = [], bytearray()
    for c in data + b"\0":
        if 32 <= c < 127:
            run.append(c)
        else:
            if len(run) >= 8:
                out.append(run.decode())
            run.clear()
    return out


@F.arrow_udf(StringType())
def image_text(contents: pa.Array) -> pa.Array:
    return pa.array([metadata_text(v.as_py()) for v in contents], pa.string())

"""Decoding: texts hidden in other texts by encodings, found and decoded layer by layer.

All layers of a text come from one pass of an Arrow operator without a shuffle; the depth is bounded.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators.normalize import normalized

# Fixed limits: depth of decoding, characters of a layer that is decoded further, bytes a compressed text may grow to. Nothing else is limited:
# a layer over the second is still read by all detectors, and the scan has a finding that it wasn't decoded further; what was cut by the third has "cut" in its chain.
DEPTH, LAYER_BYTES, DECODED_BYTES = 3, 1 << 20, 4 << 20

# Names of the encodings, and the least lengths from which a run of their signs is one.
_SHAPES = {
    "base64": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])"),
    "base64url": re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9]*[-_])[A-Za-z0-9_-]{40,}={0,2}"),
    "base32": re.compile(r"\b[A-Z2-7]{32,}={0,6}(?![A-Z2-7=])"),
    "hex": re.compile(r"(?<![0-9A-Za-z])(?:0x)?(?:[0-9a-fA-F]{2}[ :,]?){23,}[0-9a-fA-F]{2}(?![0-9A-Fa-f])"),
    "url": re.compile(r"(?:%[0-9a-fA-F]{2}){8,}"),
    "escape": re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]{1,6}\}|\\[0-7]{3}){6,}"),
    "entity": re.compile(r"(?:&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]\w{1,30});){5,}"),
    "charcodes": re.compile(r"(?:chr|fromCharCode|char)\s*\(\s*\d{2,3}(?:\s*,\s*\d{2,3})*\s*\)(?:\s*[.+&]\s*(?:chr|char)\s*\(\s*\d{2,3}\s*\))*|\b\d{2,3}(?:\s*,\s*\d{2,3}){7,}\b", re.I),
    "split": re.compile(r"""(["'])[^"'\n]{1,200}\1(?:\s*(?:\+|\.\.?|,|\\|&)\s*(["'])[^"'\n]{1,200}\2){2,}"""),
}
_PIECE = re.compile(r"""(["'])([^"'\n]*)\1""")
_ESCAPED = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\u\{([0-9a-fA-F]{1,6})\}|\\([0-7]{3})")
#: Words that show a text to be plain: English ones, and Russian ones, in which rot13 changes nothing.
STOP_WORDS = (" the ", " and ", " you ", " that ", " with ", " this ", " for ", " are ", " not ")
PLAIN_WORDS = (*STOP_WORDS, " и ", " не ", " что ", " на ", " это ", " как ")
_ROT13 = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm")


def plausible(raw: bytes) -> str | None:
    """The text of decoded bytes: at least 8 of them, valid UTF-8, 85 of 100 characters printable or blank."""
    if len(raw) < 8:
        return None
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    shown = sum(c.isprintable() or c.isspace() for c in text)
    return text if shown >= 0.85 * len(text) else None


def _unpacked(raw: bytes) -> tuple[bytes, str]:
    """``raw`` without gzip or zlib around it, and what was taken off; where it grows over the limit, as much of it as that, and "cut"."""
    for magic, wbits, name in ((b"\x1f\x8b", 31, "+gzip"), (b"\x78", 15, "+zlib")):
        if raw.startswith(magic):
            try:
                unpack = zlib.decompressobj(wbits)
                out = unpack.decompress(raw, DECODED_BYTES)
                if not unpack.unconsumed_tail and not unpack.decompress(b"", 1):
                    return out, name
                while out and out[-1] & 0xC0 == 0x80:  # not within a character
                    out = out[:-1]
                return out[:-1] if out and out[-1] >= 0xC0 else out, name + "+cut"
            except zlib.error:
                pass
    return raw, ""


def _decoded(encoding: str, found: str) -> bytes | None:
    try:
        if encoding == "base64":
            return base64.b64decode(found.rstrip("=") + "=" * (-len(found.rstrip("=")) % 4), validate=True)
        if encoding == "base64url":
            return base64.urlsafe_b64decode(found.rstrip("=") + "=" * (-len(found.rstrip("=")) % 4))
        if encoding == "base32":
            return base64.b32decode(found.rstrip("=") + "=" * (-len(found.rstrip("=")) % 8))
        if encoding == "hex":
            return bytes.fromhex(re.sub(r"[ :,]|^0x", "", found))
        if encoding == "url":
            return unquote_to_bytes(found)
        if encoding == "escape":
            out = bytearray()
            for x, u, point, octal in _ESCAPED.findall(found):
                out += bytes([int(x, 16)]) if x else chr(int(u or point, 16)).encode() if u or point else bytes([int(octal, 8) & 255])
            return bytes(out)
        if encoding == "entity":
            return html.unescape(found).encode()
        if encoding == "charcodes":
            codes = [int(n) for n in re.findall(r"\d{2,3}", found)]
            return bytes(c for c in codes if 32 <= c <= 126) if len(codes) >= 8 else None
        joined = "".join(p for _, p in _PIECE.findall(found)).encode()
        return joined if len(joined) >= 12 else None
    except (ValueError, binascii.Error, UnicodeEncodeError, OverflowError):
        return None


_LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*+)("?)')
_STRING_ESCAPE = re.compile(r"\\(?:([abfnrtv\\\"])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|[\s\S]?)")
_SIGNS = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", '"': '"'}
_ENTITY = re.compile(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});|&[a-zA-Z][a-zA-Z0-9]{1,31};")


def _unquoted(body: str) -> bytes | None:
    """What a quoted literal stands for; null where an escape isn't one of source literals."""
    out, last = [], 0
    for m in _STRING_ESCAPE.finditer(body):
        out.append(body[last : m.start()].encode())
        last = m.end()
        sign, x, u, wide, octal = m.groups()
        if sign:
            out.append(_SIGNS[sign].encode())
        elif x or (octal and int(octal, 8) < 256):
            out.append(bytes([int(x, 16) if x else int(octal, 8)]))
        elif (u or wide) and (point := int(u or wide, 16)) < 0x110000 and not 0xD800 <= point < 0xE000:
            out.append(chr(point).encode())
        else:
            return None
    return b"".join([*out, body[last:].encode()])


def _literals(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of quoted literals of 16 or more signs with 3 or more backslashes. In one go: where a literal isn't closed on its line, none in it is."""
    at = text.find('"')
    while at >= 0:
        m = _LITERAL.match(text, at)
        body = m[1]
        if m[2] and len(re.sub(r"\\.", ".", body)) >= 16:
            if body.count("\\") >= 3 and (raw := _unquoted(body)) is not None:
                yield m.start(), m.end(), raw
            at = text.find('"', m.end())
        else:
            at = text.find('"', m.end() - 1 if m[2] else m.end())


def _paragraphs(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of the paragraphs with an entity, decoded whole."""
    at = 0
    for part in text.split("\n\n") if "&" in text else ():
        if _ENTITY.search(part):
            yield at, at + len(part), html.unescape(part).encode("utf-8", "replace")
        at += len(part) + 2


def candidates(text: str | None) -> list[tuple[str, int, int, str]]:
    """(encoding, start, end, decoded) of each readable text encoded in ``text``; offsets in characters. Overlapping ones are all given."""
    if not text:
        return []
    out = []
    for encoding, shape in _SHAPES.items():
        for m in shape.finditer(text):
            raw = _decoded(encoding, m[0])
            if raw is None:
                continue
            raw, packed = _unpacked(raw)
            decoded = plausible(raw)
            if decoded is not None and decoded != m[0]:
                out.append((encoding + packed, m.start(), m.end(), decoded))
    for encoding, found in (("json", _literals(text)), ("entities-context", _paragraphs(text))):
        for start, end, raw in found:
            raw, packed = _unpacked(raw)
            decoded = plausible(raw)
            if decoded is not None and decoded != text[start:end].strip('"' if encoding == "json" else ""):
                out.append((encoding + packed, start, end, decoded))
    low = text.lower()
    if len(text.encode("utf-8", "replace")) >= 40 and not any(w in low for w in PLAIN_WORDS):
        turned = text.translate(_ROT13)
        if sum(w in turned.lower() for w in STOP_WORDS) >= 2:
            out.append(("rot13", 0, len(text), turned))
    return out


@dataclass(frozen=True)
class Layer:
    """A text under a document: where it is in the layer above and in the document, in characters, its normalised text, and what is encoded in it."""

    depth: int
    chain: tuple[str, ...]
    start: int
    end: int
    root_start: int
    root_end: int
    text: str
    inside: list[tuple[str, int, int, str]]


def unwrapped(text: str | None, depth: int = DEPTH) -> Iterator[Layer]:
    """The normalised text itself as the layer of depth 0, then all layers under it; each is normalised before it is decoded further."""
    if not text:
        return
    whole = normalized(text)
    waiting = [(0, (), 0, len(whole), 0, len(whole), whole)]
    while waiting:
        at, chain, start, end, root_start, root_end, value = waiting.pop()
        inside = candidates(value) if at == 0 or len(value) <= LAYER_BYTES else []
        yield Layer(at, chain, start, end, root_start, root_end, value, inside)
        if at < depth:
            for encoding, a, b, decoded in reversed(inside):
                waiting.append((at + 1, (*chain, encoding), a, b, *((root_start, root_end) if at else (a, b)), normalized(decoded)))


def layers(docs: DataFrame, key: str, text: str, depth: int = DEPTH) -> DataFrame:
    """All layers under the documents' texts: key, depth, chain, start, end, decoded.

    ``chain`` lists the encodings from the outermost in, start and end are in the normalised layer above, ``decoded`` is normalised.
    Null and empty texts have none; decoded layers over the size limit aren't decoded further, the documents' own texts are read whole; equal rows give equal layers each.
    """
    schema = f"__key {docs.schema[key].dataType.simpleString()}, depth int, chain array<string>, start int, end int, decoded string"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = (batch.schema.field(0).type, pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string())
            names = ["__key", "depth", "chain", "start", "end", "decoded"]
            rows = ((k, x.depth, list(x.chain), x.start, x.end, x.text) for k, value in zip(*[c.to_pylist() for c in batch.columns], strict=True) for x in unwrapped(value, depth) if x.depth)
            yield from batched(rows, names, kinds)

    return docs.select(F.col(key).alias("__key"), F.col(text).alias("value")).mapInArrow(step, schema).withColumnRenamed("__key", key)


#: Characters of text and rows after which a batch is given on.
_BATCH_CHARS, _BATCH_ROWS = 4 << 20, 10_000


def batched(rows: Iterable[tuple], names: list[str], kinds: tuple) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; the rows' last field is their text."""
    waiting: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*waiting, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for row in rows:
        waiting.append(row)
        size += len(row[-1] or "")
        if size >= _BATCH_CHARS or len(waiting) >= _BATCH_ROWS:
            yield batch()
            waiting, size = [], 0
    if waiting:
        yield batch()

"""Secret scans through nested encodings: a worklist of decoded layers, each rescanned, with spans mapped back."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sightline.llm.common import documents, map_batches, texts
from sightline.llm.registry import query

# fixed values: the kinds in their order, their patterns and least lengths (of the value, the match, the match)
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
#: What must be in a text, in lower case, for ASSIGN to match.
STEMS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Bytes that one compressed stream may unfold to; beyond it the layer is cut there and counted in n_cut.
UNFOLD = 64 << 20
#: First bytes of a possible stream that are tried before all of it is.
PROBE = 64
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run of base64 letters at the end of a line and the lines after it that start with one; linear, since nothing is given back.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
SPACE = re.compile(r"\s")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&#(?:(\d{1,7})|[xX]([0-9A-Fa-f]{1,6}));")
PACKED = ((b"\x1f\x8b", "gzip"), (b"x\x01", "zlib"), (b"x\x5e", "zlib"), (b"x\x9c", "zlib"), (b"x\xda", "zlib"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"))
CODERS = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}


def scan(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of a text, leftmost and non-overlapping for each kind."""
    low = text.lower()
    if any(s in low for s in STEMS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_VALUE:
                yield m.start(), 0, m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            yield m.start(), 1, m.end()
    for m in HEX.finditer(text):
        yield m.start(), 2, m.end()


class Layer:
    """A decoded text and, for each of its characters, where in the document it comes from."""

    __slots__ = ("text", "lo", "hi")

    def __init__(self, text: str, lo, hi):
        self.text, self.lo, self.hi = text, lo, hi


def by_escape(m: re.Match) -> str:
    for group, base in zip(m.groups(), (16, 16, 16, 10, 16)):
        if group is not None:
            code = int(group, base)
            return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
    return m[0]


def pieces(segment: str, kind: str) -> Iterator[tuple[str, int, int]]:
    """(decoded text, start, end) of the stretches of an encoded segment."""
    at = 0
    if kind == "unicode":
        for m in ESCAPE.finditer(segment):
            yield from ((segment[i], i, i + 1) for i in range(at, m.start()))
            yield by_escape(m), m.start(), m.end()
            at = m.end()
    else:
        for m in PERCENT.finditer(segment):
            yield from ((segment[i], i, i + 1) for i in range(at, m.start()))
            raw, place = bytes.fromhex(m[0].replace("%", "")), m.start()
            for char in raw.decode("utf-8", "replace"):
                size = len(char.encode()) if char != "\ufffd" else 1
                yield char, place, min(place + 3 * size, m.end())
                place = min(place + 3 * size, m.end() - 1)
            at = m.end()
    yield from ((segment[i], i, i + 1) for i in range(at, len(segment)))


def unfold(raw: bytes, kind: str) -> tuple[bytes, bool, bool]:
    """The unpacked bytes of all members of a stream, whether they were cut at UNFOLD, and whether the stream is whole.

    The bytes go in by small steps, so a damaged or broken-off stream gives what came before the break.
    """
    magics = tuple(magic for magic, k in PACKED if k == kind)
    out, rest = bytearray(), raw
    while rest.startswith(magics):
        coder, step, at = CODERS[kind](), 1 + len(rest) // 4096, 0
        try:
            while at < len(rest) and not coder.eof:
                out += coder.decompress(rest[at : at + step], UNFOLD - len(out))
                at += step
                if len(out) >= UNFOLD:
                    return bytes(out), True, False
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            return bytes(out), False, False
        if not coder.eof:
            return bytes(out), False, False
        rest = coder.unused_data + rest[at:]
    return bytes(out), False, True


def plain(raw: bytes, whole: bool = True) -> str | None:
    """The text of bytes that are text: valid UTF-8 without control characters; the end may be within a character if not whole."""
    for end in range(len(raw), max(-1, len(raw) - (1 if whole else 4)), -1):
        try:
            text = raw[:end].decode("utf-8")
        except UnicodeDecodeError:
            continue
        return text if text and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else None
    return None


def packing(raw: bytes) -> str | None:
    return next((kind for magic, kind in PACKED if raw.startswith(magic)), None)


def starts(head: bytes) -> bool:
    """Whether the first bytes of a stream unpack, so that the rest is not copied for every chance magic."""
    coder = CODERS[packing(head)]()
    got = 0
    try:
        for i in range(len(head)):
            got += len(coder.decompress(head[i : i + 1], PROBE))
    except EOFError:  # a whole stream, with more after it
        return True
    except (zlib.error, OSError, ValueError, lzma.LZMAError):
        return got > 0
    return True


def unpacked(raw: bytes) -> tuple[str | None, bool]:
    """The text under any compression, and whether it was cut."""
    cut, whole, seen = False, True, set()
    while (kind := packing(raw)) and (mark := hashlib.sha256(raw).digest()) not in seen:
        seen.add(mark)
        raw, more, all_there = unfold(raw, kind)
        cut |= more
        whole &= all_there
    return plain(raw, whole), cut


def opened(segment: str) -> tuple[str | None, bool]:
    """The text under base64 and any compression around it, and whether it was cut."""
    body = segment.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None, False
    return unpacked(raw)


def wrapped(text: str) -> Iterator[tuple[str, int, int]]:
    """(joined letters, start, end) of base64 that is wrapped over lines: inner lines of one width, the last no longer."""
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in LINE.finditer(m[0])]
        at = 0
        while at + 1 < len(lines):
            width = lines[at + 1][1] - lines[at + 1][0]
            end = at + 2
            while end < len(lines) and lines[end][1] - lines[end][0] == width:
                end += 1
            stops = [end]
            if end < len(lines) and lines[end][1] - lines[end][0] < width:
                stops.append(end + 1)
            elif end == at + 2 or end == len(lines):
                stops.append(end - 1)  # the last line may be a word of what follows
            for stop in stops:
                if stop - at > 1:
                    yield "".join(text[a:b] for a, b in lines[at:stop]), lines[at][0], lines[stop - 1][1]
            at = end - 1 if end == at + 2 else end


def escaped_bytes(segment: str) -> tuple[bytes, list[int]]:
    """The bytes that a segment with percent escapes stands for, and the place of each."""
    out, places, at = bytearray(), [], 0
    while at < len(segment):
        m = PERCENT.match(segment, at)
        if m:
            raw = bytes.fromhex(m[0].replace("%", ""))
            places += range(at, m.end(), 3)
            at = m.end()
        else:
            raw = segment[at].encode("utf-8", "surrogatepass")
            places += [at] * len(raw)
            at += 1
        out += raw
    return bytes(out), places


def packed_escapes(segment: str) -> Iterator[tuple[str, int, bool]]:
    """(text, start, cut) of compressed streams whose bytes are percent-escaped; each stream is tried from its first bytes."""
    raw, places = escaped_bytes(segment)
    if plain(raw) is not None:
        return
    for at in sorted({m.start() for magic, _ in PACKED for m in re.finditer(re.escape(magic), raw)}):
        if not starts(raw[at : at + PROBE]):
            continue
        text, cut = unpacked(raw[at:])
        if text:
            yield text, places[at], cut


def runs(text: str, core: re.Pattern) -> Iterator[tuple[int, int]]:
    """Runs without white space that hold a match of ``core``; linear in the text."""
    done = 0
    for m in core.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = SPACE.search(text, m.end())
        done = end.start() if end else len(text)
        yield start, done


def widened(text: str, start: int, end: int) -> tuple[int, int]:
    """A run with up to two runs on each side that only spaces part from it: an assignment has spaces in two places at most."""
    for _ in range(2):
        at = start
        while at and text[at - 1] == " ":
            at -= 1
        if at < start:
            while at and not text[at - 1].isspace():
                at -= 1
            start = at
        at = end
        while at < len(text) and text[at] == " ":
            at += 1
        if at > end:
            stop = SPACE.search(text, at)
            end = stop.start() if stop else len(text)
    return start, end


def decoded(layer: Layer) -> Iterator[tuple[Layer, bool]]:
    """The layers directly below a layer."""
    text = layer.text
    if "%" in text:
        for start, end in runs(text, PERCENT):
            for inner, at, cut in packed_escapes(text[start:end]):
                yield Layer(inner, Same(layer.lo[start + at]), Same(layer.hi[end - 1])), cut
    for kind, core, sign in (("url", PERCENT, "%"), ("unicode", ESCAPE, "\\"), ("unicode", ESCAPE, "&#")):
        if sign not in text or sign == "&#" and "\\" in text:
            continue
        for start, end in dict.fromkeys(x for run in runs(text, core) for x in (run, widened(text, *run))):
            parts = list(pieces(text[start:end], kind))
            inner = "".join(p[0] for p in parts)
            if inner != text[start:end]:
                yield Layer(inner, [layer.lo[start + a] for _, a, _ in parts], [layer.hi[start + b - 1] for _, _, b in parts]), False
    for m in BASE64.finditer(text):
        if worth(m[0]):
            inner, cut = opened(m[0])
            if inner is not None:
                yield Layer(inner, Same(layer.lo[m.start()]), Same(layer.hi[m.end() - 1])), cut
    if "\n" in text:
        for joined, start, end in wrapped(text):
            if worth(joined):
                inner, cut = opened(joined)
                if inner is not None:
                    yield Layer(inner, Same(layer.lo[start]), Same(layer.hi[end - 1])), cut


def worth(segment: str) -> bool:
    """Whether a run of base64 letters can hold text: words of one case don't (each third byte of text in base64 shows capitals)."""
    return not (segment.islower() or segment.isupper() or segment[1:].islower())


class Same:
    """The same place for every character."""

    def __init__(self, place: int):
        self.place = place

    def __getitem__(self, _: int) -> int:
        return self.place


class Places:
    """A document's own characters."""

    def __init__(self, add: int):
        self.add = add

    def __getitem__(self, i: int) -> int:
        return i + self.add


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int, int]:
    """Base spans, all spans (start, kind, end), the layers that were opened, and those that were cut.

    The worklist starts with the document. Each layer is scanned, then what is encoded in it goes
    on the list, until nothing new comes up; a content already seen at the same place is not opened
    again, which ends cycles. A match in a layer covers the characters of the document that it was
    decoded from: exactly those for URL and Unicode escapes, the whole run for base64 and compression.
    """
    base = sorted(scan(text))
    spans, work, seen = set(base), [Layer(text, Places(0), Places(1))], set()
    layers = cuts = 0
    while work:
        layer = work.pop()
        for below, cut in decoded(layer):
            mark = (hashlib.sha256(below.text.encode("utf-8", "surrogatepass")).digest(), below.lo[0], below.hi[len(below.text) - 1])
            cuts += cut
            if mark in seen:
                continue
            seen.add(mark)
            layers += 1
            for start, kind, end in scan(below.text):
                spans.add((below.lo[start], kind, below.hi[end - 1]))
            work.append(below)
    return base, sorted(spans), layers, cuts


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base matches), base_sha256, spans, n_layers, n_cut of each row, in one pass.

    Null texts count as empty and have no spans; a text of any length is scanned whole; rows
    repeat as they come; extra columns are not read; an empty table gives an empty result.
    """

    def batch(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for text in rows["text"]:
            base, spans, layers, cuts = find(text)
            counts = np.bincount([k for _, k, _ in base], minlength=3).tolist() if base else [0, 0, 0]
            out.append((*counts, hashlib.sha256(told(base).encode()).hexdigest(), told(spans), layers, cuts))
        result = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers", "n_cut"])
        result.insert(0, "doc_id", rows["doc_id"].array)
        return result

    return map_batches(texts(docs), batch, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint, n_cut bigint")


@query("op1_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir, "doc_id", "text"))

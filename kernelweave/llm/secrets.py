"""Secret scans over whole texts and everything that is encoded inside them.

A worklist starts with the text itself. Each layer is scanned with the same three patterns and unwrapped
further: percent escapes, Unicode escapes and numeric character references give a new whole layer;
each base64 run, on one line or wrapped over several, and each percent-escaped byte run gives its bytes.
A run with slashes that gives nothing as a whole, as the end of a path, is tried after each slash too.
Bytes that are gzip, zlib, bzip2 or xz are inflated, member after member and as often as it takes; others
that are no text are tried as raw deflate. Inflation streams: pieces of at most ``PIECE`` characters are
scanned to the end, cut at line ends where no encoded run goes on; a longer line is cut with ``OVERLAP``
characters in common. Decoding goes on until no layer is new; a layer that was seen before (same text for
the same place), or a stream that inflates to what it began with, is not entered again, so that
self-reproducing archives end too. Each layer knows by runs which span of the document it came from, and
findings are reported there; all that an inflated layer holds maps to the span of its run.

Defined results: a null text is the empty text and has no findings; bytes that are no UTF-8 make no
layer, but if they were inflated, odd bytes in them become U+FFFD; a compressed stream that is damaged or
ends early is read up to there, counts in ``cut_layers``, and is blotted out whole by ``redact``; so does
a line longer than a piece, whose nested runs may be cut; an empty table gives no rows; repeated rows give
repeated results; further columns pass through ``redact`` and are not read by ``scan``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from codecs import getincrementaldecoder
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, pieces, table, text_or_empty

PIECE = 1 << 22
OVERLAP = 1 << 18
CHUNK = 1 << 20  # bytes inflated at a time
HEAD = 4096  # bytes by which streams are told apart
ROWS = 512
KINDS = ("assign", "access", "hex")
REDACTED = "[REDACTED]"

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: Some of these is in every text with an assignment, once its A-Z are in lower case.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: A run is one match, so a least length in the pattern drops the same matches as a check afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: A first line, more of them and a last one, which may be shorter; indents and quotes of mails may precede.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t>]*[A-Za-z0-9+/_-]{16,})*\r?\n[ \t>]*[A-Za-z0-9+/_-]+={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")


Span = Callable[[int, int], tuple[int, int]]


@dataclass(frozen=True)
class Layer:
    text: str
    span: Span  # the place in the document that characters i to j came from
    path: tuple[str, ...] = ()
    cut: bool = False


@dataclass(frozen=True, order=True)
class Finding:
    start: int
    rank: int  # of the kind
    end: int
    layer: str  # "" in the document itself, else how it was unwrapped
    value: str

    @property
    def kind(self) -> str:
        return KINDS[self.rank]


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind's rank, start, end) of the three patterns in one text."""
    out = []
    lower = text.encode("utf-8", "replace").lower()
    if any(word in lower for word in ASSIGN_WORDS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in lower:
        out += [(1, *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in HEX.finditer(text)]
    return out


#: Head, name and opener of what can be inflated.
FORMATS = (
    (b"\x1f\x8b\x08", "gzip", lambda: zlib.decompressobj(31)),
    (b"x", "zlib", lambda: zlib.decompressobj(15)),
    (b"BZh", "bzip2", bz2.BZ2Decompressor),
    (b"\xfd7zXZ\x00", "xz", lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ)),
)
BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)


def _fed(stream, data: bytes) -> Iterator[bytes]:
    """What a stream gives for some bytes, ``CHUNK`` by ``CHUNK``."""
    out = stream.decompress(data, CHUNK)
    while out:
        yield out
        if stream.eof:
            break
        # zlib hands back what it has not read, the others keep it
        out = stream.decompress(getattr(stream, "unconsumed_tail", b""), CHUNK)


def inflated(chunks: Iterator[bytes], magic: bytes, opener, damage: list) -> Iterator[bytes]:
    """The bytes of one member after the other. A stream that is damaged or ends early is noted."""
    stream = opener()
    for data in chunks:
        while data:
            if stream is None:  # between members, where zeros may pad
                data = data.lstrip(b"\0")
                if not data.startswith(magic):
                    break
                stream = opener()
            try:
                yield from _fed(stream, data)
            except BROKEN:
                damage.append("damaged")
                return
            if not stream.eof:
                break
            data, stream = stream.unused_data, None
    if stream is not None:
        damage.append("ends early")


def _opens(opener, head: bytes) -> bool:
    try:
        return bool(opener().decompress(head, 1))
    except BROKEN:
        return False


def unwrapped(data: bytes, damage: list) -> tuple[tuple[str, ...], Iterator[bytes]]:
    """The formats that some bytes are wrapped in, and a stream of what is inside all of them."""
    names: tuple[str, ...] = ()
    chunks, heads = iter((data,)), set()
    while True:
        head = next(chunks, b"")
        chunks = chain((head,), chunks)
        fits = [f for f in FORMATS if head.startswith(f[0]) and _opens(f[2], head)]
        if not fits or head[:HEAD] in heads:
            return names, chunks
        heads.add(head[:HEAD])
        magic, name, opener = fits[0]
        names, chunks = (*names, name), inflated(chunks, magic, opener, damage)


def text_pieces(chunks: Iterator[bytes], damage: list) -> Iterator[str]:
    """The text of a stream, in pieces that end where no match and no run of base64 lines can go on."""
    decoder, held = getincrementaldecoder("utf-8")("replace"), ""
    for data in chunks:
        held += decoder.decode(data)
        while len(held) >= PIECE:
            at = len(held)
            for _ in range(1000):
                at = held.rfind("\n", 0, at)
                before = held[held.rfind("\n", 0, max(at, 0)) + 1 : max(at, 0)].strip("\r \t>")
                if at < 0 or not LINE.fullmatch(before):
                    break
            if at > 0:
                piece, held = held[: at + 1], held[at + 1 :]
            else:
                damage.append("long line")
                piece, held = held, held[-OVERLAP:]
            yield piece
    held += decoder.decode(b"", True)
    if held:
        yield held


def _replaced(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with each match that ``decode`` understands replaced.

    Characters of a match that is a whole number of times as long stand for their share of it, others for all of it.
    """
    parts: list[str] = []
    news, olds, widths = [0], [0], [1]  # runs: first characters here and there, and how many there are one here (0: all)
    ends, here, at = [0], 0, 0
    for m in pattern.finditer(layer.text):
        new = decode(m[0])
        if new is None:
            continue
        i, j = m.span()
        parts += [layer.text[at:i], new]
        here += i - at
        width = (j - i) // len(new) if new and (j - i) % len(new) == 0 else 0
        news += [here, here + len(new)]
        olds += [i, j]
        widths += [width, 1]
        ends += [j, j]
        here += len(new)
        at = j
    if not parts:
        return None
    parts.append(layer.text[at:])

    def span(i: int, j: int) -> tuple[int, int]:
        a, b = bisect_right(news, i) - 1, bisect_right(news, j - 1) - 1
        first = olds[a] + (i - news[a]) * widths[a]
        last = olds[b] + (j - news[b]) * widths[b] if widths[b] else ends[b]
        return layer.span(first, last)

    return Layer("".join(parts), span, (*layer.path, name))


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _escape(run: str) -> str | None:
    try:
        if run.startswith("\\x"):
            return bytes.fromhex(run.replace("\\x", "")).decode("latin-1")
        if run.startswith("\\u") and run[2] != "{":
            return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be")
        digits = run.strip("\\uU{}&#;")
        base = 10 if run.startswith("&#") and digits[:1] not in "xX" else 16
        made = chr(int(digits.lstrip("xX"), base))
        return None if "\ud800" <= made <= "\udfff" else made
    except (ValueError, OverflowError):
        return None


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _whole(layer: Layer, i: int, j: int, data: bytes, name: str) -> Iterator[Layer]:
    """Layers of what some compressed bytes hold; none where they are not compressed. The last says if something is unread."""
    damage: list = []
    names, chunks = unwrapped(data, damage)
    if not names and name == "base64":
        names, chunks = _raw_deflate(data)
    if names:
        at = layer.span(i, j)
        path = (*layer.path, name, *names)
        for piece in text_pieces(chunks, damage):
            yield Layer(piece, lambda *_: at, path)
        if damage:
            yield Layer("", lambda *_: at, path, cut=True)


def _raw_deflate(data: bytes) -> tuple[tuple[str, ...], Iterator[bytes]]:
    """Without a head to tell it by, only a stream that ends with the data and gives text counts."""
    stream = zlib.decompressobj(-15)
    decoder = getincrementaldecoder("utf-8")()
    try:
        for out in _fed(stream, data):
            decoder.decode(out)
        decoder.decode(b"", True)
    except (*BROKEN, UnicodeDecodeError):
        return (), iter(())
    if not stream.eof or stream.unused_data or stream.unconsumed_tail:
        return (), iter(())
    return ("deflate",), _fed(zlib.decompressobj(-15), data)


def _from_base64(layer: Layer, starts: list[int], lines: list[str]) -> Iterator[Layer]:
    """Layers of a base64 run whose lines start at the given places."""
    run = "".join(lines)
    data = _base64(run)
    if data is None:
        return
    places, total = [], 0  # of the first character of each line in the run
    for line in lines:
        places.append(total)
        total += len(line)
    last = len(run) - 1

    def outside(k: int) -> int:
        line = bisect_right(places, k) - 1
        return starts[line] + k - places[line]

    try:
        inner = data.decode()
    except UnicodeDecodeError:
        yield from _whole(layer, starts[0], outside(last) + 1, data, "base64")
        return
    if any(data.startswith(magic) for magic, _, _ in FORMATS):
        yield from _whole(layer, starts[0], outside(last) + 1, data, "base64")
    plain = inner.isascii()

    def span(i: int, j: int) -> tuple[int, int]:  # the groups of four characters that hold the bytes
        if not plain:
            i, j = len(inner[:i].encode()), len(inner[:j].encode())
        return layer.span(outside(min(last, i // 3 * 4)), outside(min(last, (j - 1) // 3 * 4 + 3)) + 1)

    if inner:
        yield Layer(inner, span, (*layer.path, "base64"))


def _promising(run: str) -> bool:
    """Whether the first bytes of a base64 run are text or the head of a format."""
    data = _base64(run[:24])
    if not data:
        return False
    if any(data.startswith(magic) for magic, _, _ in FORMATS):
        return True
    head = data.decode("utf-8", "ignore")
    return len(head.encode()) >= len(data) - 3 and (head.isprintable() or not any(c < " " and c not in "\t\r\n" for c in head))


def _base64_layers(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    for m in BASE64.finditer(text):
        found = False
        for inner in _from_base64(layer, [m.start()], [m[0]]):
            found = True
            yield inner
        if not found and "/" in m[0]:
            at = m[0].find("/")
            while at >= 0:
                if len(m[0]) - at > 16 and _promising(m[0][at + 1 :]):
                    yield from _from_base64(layer, [m.start() + at + 1], [m[0][at + 1 :]])
                end = m[0].find("/", at + 1)
                # a part between slashes, in case that the path goes on behind it
                if end - at > 16 and _promising(m[0][at + 1 : end]):
                    yield from _from_base64(layer, [m.start() + at + 1], [m[0][at + 1 : end]])
                at = end
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            lines = [(m.start() + x.start(), x[0]) for x in LINE.finditer(m[0])]
            at = 0
            while at < len(lines) - 1:  # lines of one length and a last one that is no longer
                width = len(lines[at][1])
                end = at + 1
                while end < len(lines) and len(lines[end][1]) == width:
                    end += 1
                if end < len(lines) and len(lines[end][1]) < width:
                    end += 1
                if end - at > 1:
                    yield from _from_base64(layer, [i for i, _ in lines[at:end]], [x for _, x in lines[at:end]])
                at = max(end - 1, at + 1) if end < len(lines) else end


def below(layer: Layer) -> Iterator[Layer]:
    """What the layer unwraps to."""
    text = layer.text
    if "%" in text:
        if one := _replaced(layer, PERCENT, _percent, "url"):
            yield one
        for m in PERCENT.finditer(text):
            if m.end() - m.start() >= 24:
                yield from _whole(layer, *m.span(), bytes.fromhex(m[0].replace("%", "")), "url")
    if "\\" in text or "&#" in text:
        if one := _replaced(layer, ESCAPE, _escape, "unicode"):
            yield one
    yield from _base64_layers(layer)


def scan_text(text: str) -> tuple[list[Finding], list[tuple[int, int]]]:
    """Findings by place, and spans of layers that could not be read to the end.

    A decoded finding of a kind and span known already is left out.
    """
    work: list[Iterator[Layer]] = [iter((Layer(text, lambda i, j: (i, j)),))]
    seen, found, cuts = set(), {}, set()
    while work:
        layer = next(work[-1], None)  # depth first: of each layer above, only one piece is held
        if layer is None:
            work.pop()
            continue
        if layer.cut:
            cuts.add(layer.span(0, 0))
        if not layer.text:
            continue
        key = (hash(layer.text), len(layer.text), layer.span(0, len(layer.text)))
        if key in seen:
            continue
        seen.add(key)
        for rank, i, j in matches(layer.text):
            a, b = layer.span(i, j)
            found.setdefault((a, rank, b), Finding(a, rank, b, ">".join(layer.path), layer.text[i:j]))
        work.append(below(layer))
    return sorted(found.values()), sorted(cuts)


def redact_text(text: str) -> str:
    """The text with every finding's span, encoded ones whole, and every unread layer's replaced by a mark."""
    found, cuts = scan_text(text)
    out, at = [], 0
    for start, end in sorted({(f.start, f.end) for f in found} | set(cuts)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], REDACTED]
        at = end
    return "".join([*out, text[at:]]) if out else text


FINDING = "array<struct<kind: string, start: int, end: int, layer: string, value: string>>"


def scan(df: DataFrame) -> DataFrame:
    """doc_id, findings (kind, span in code points, layer, value) and cut_layers of each (doc_id, text)."""

    def start():
        def step(batch):
            scanned = [scan_text(text) for text in batch["text"]]
            findings = [
                [{"kind": f.kind, "start": f.start, "end": f.end, "layer": f.layer, "value": f.value} for f in found]
                for found, _ in scanned
            ]
            return {"doc_id": batch["doc_id"], "findings": findings, "cut_layers": [len(cuts) for _, cuts in scanned]}

        return step

    rows = df.select("doc_id", text_or_empty().alias("text"))
    return map_batches(rows, f"doc_id long, findings {FINDING}, cut_layers int", start)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; texts with findings have them blotted out, and ``n_chars`` follows. Null texts stay null."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, ROWS):
                texts = [t if t is None else redact_text(t) for t in piece.column(place).to_pylist()]
                yield piece.set_column(place, piece.schema.field(place), pa.array(texts, piece.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    def spans(found):
        return F.array_join(
            F.transform(found, lambda f: F.concat_ws(":", f.kind, f.start.cast("string"), f["end"].cast("string"))), ","
        )

    found = scan(docs).withColumn("base", F.filter("findings", lambda f: f.layer == ""))

    def count(kind):
        return F.size(F.filter("base", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"),
        "cut_layers",
    )

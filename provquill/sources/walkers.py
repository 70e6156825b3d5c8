"""Container walkers: pure functions on bytes that never raise and never trust a length.

Each gives (kind, offset, size, body) entries; bodies are clipped, offsets and sizes are those declared.  A walk
ends at the first malformed entry.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

from ..operators import dims

Entry = tuple[str, int, int, bytes]

PNG, JPEG_START, RIFF = b"\x89PNG\r\n\x1a\n", b"\xff\xd8", b"RIFF"
#: Bytes of one body that are kept, and of the end that is searched for an end mark.
BODY, QUICK = 1 << 20, 1 << 19
_PROVENANCE_BOXES = ("uuid", "jumb")
# Boxes that hold other boxes.
_CONTAINERS = ("moov", "udta", "trak", "mdia", "minf", "stbl", "ilst", "dinf", "edts", "meta")
# Entries of coded pixels and sound, whose bodies nothing reads.
_CODED = ("IDAT", "fdAT", "VP8 ", "VP8L", "ALPH", "ANMF", "movi", "mdat", "idat", "free")


def sniff(data: bytes) -> str:
    """png, jpeg, webp, avi, wav, isobmff, ebml, flv, gif, bmp, tiff or unknown."""
    if data.startswith(PNG):
        return "png"
    if data.startswith(JPEG_START):
        return "jpeg"
    if data[:4] == RIFF:
        return {b"WEBP": "webp", b"AVI ": "avi", b"WAVE": "wav"}.get(data[8:12], "riff")
    if data[4:8] == b"ftyp":
        return "isobmff"
    for magic, name in ((b"\x1a\x45\xdf\xa3", "ebml"), (b"FLV\x01", "flv"), (b"GIF8", "gif"), (b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff")):
        if data.startswith(magic):
            return name
    return "unknown"


def png_chunks(data: bytes) -> Iterator[Entry]:
    at = len(PNG)
    while data.startswith(PNG) and at + 8 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind = data[at + 4 : at + 8].decode("latin-1")
        if size > 1 << 31 or not kind.isalpha():
            return
        yield kind, at, size, b"" if kind in _CODED else data[at + 8 : at + 8 + min(size, BODY)]
        if kind == "IEND":
            return
        at += 12 + size


def inflate(data: bytes, most: int = BODY) -> bytes | None:
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error:
        return None


def png_text(data: bytes) -> Iterator[tuple[str, str]]:
    """Keyword and text of tEXt, zTXt and iTXt chunks."""
    for kind, _, _, body in png_chunks(data):
        key, _, rest = body.partition(b"\0")
        if kind == "tEXt":
            yield key.decode("latin-1"), rest.decode("latin-1")
        elif kind == "zTXt" and rest[:1] == b"\0" and (text := inflate(rest[1:])) is not None:
            yield key.decode("latin-1"), text.decode("latin-1")
        elif kind == "iTXt" and len(rest) >= 2:
            packed, parts = rest[0], rest[2:].split(b"\0", 2)
            if len(parts) == 3 and (text := inflate(parts[2]) if packed else parts[2]) is not None:
                yield key.decode("latin-1"), text.decode("utf-8", "replace")


def jpeg_segments(data: bytes) -> Iterator[Entry]:
    """Marker segments up to and including the first scan's header."""
    at = 2
    while data.startswith(JPEG_START) and at + 4 <= len(data):
        if data[at] != 0xFF:
            return
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0x01, *range(0xD0, 0xD9)):
            yield f"{marker:02x}", at, 0, b""
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker == 0xD9 or size < 2:
            return
        yield f"{marker:02x}", at, size, data[at + 4 : at + 2 + size]
        if marker == 0xDA:
            return
        at += 2 + size


def jpeg_tables(data: bytes) -> dict:
    """Frame size, components, quantisation tables' first entries and Huffman table count."""
    out: dict = {"width": None, "height": None, "components": None, "quantisers": [], "huffman_tables": 0, "progressive": None}
    for kind, _, _, body in jpeg_segments(data):
        marker = int(kind, 16)
        if marker in (0xC0, 0xC1, 0xC2) and len(body) >= 6:
            out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "components": body[5], "progressive": marker == 0xC2}
        elif marker == 0xDB:
            at = 0
            while at < len(body):
                wide = body[at] >> 4
                out["quantisers"].append(int.from_bytes(body[at + 1 : at + 2 + bool(wide)], "big"))
                at += 1 + 64 * (1 + bool(wide))
        elif marker == 0xC4:
            out["huffman_tables"] += 1
    return out


def riff_chunks(data: bytes, start: int = 12, end: int | None = None) -> Iterator[Entry]:
    at, end = start, len(data) if end is None else min(end, len(data))
    while data[:4] == RIFF and at + 8 <= end:
        kind, size = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "little")
        yield kind, at, size, b"" if kind in _CODED else data[at + 8 : at + 8 + min(size, BODY)]
        at += 8 + size + (size & 1)


def iso_boxes(data: bytes, start: int = 0, end: int | None = None, path: str = "", depth: int = 0) -> Iterator[Entry]:
    """Boxes with their path; 64-bit and to-the-end sizes; containers are entered up to eight levels deep."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + head > end:
            return
        name = f"{path}/{kind}" if path else kind
        yield name, at, size, b"" if kind in _CODED else data[at + head : at + min(size, head + BODY)]
        if kind in _CONTAINERS and depth < 8:
            inner = at + head
            if kind == "meta" and data[inner + 4 : inner + 8] not in (b"hdlr", b"keys", b"ilst") or kind == "meta" and data[inner : inner + 4] == b"\0\0\0\0":
                inner += 4
            yield from iso_boxes(data, inner, min(at + size, end), name, depth + 1)
        at += size


def iso_provenance(data: bytes, most: int = 4 << 20) -> bytes:
    """Bodies of top-level provenance boxes, in order, up to a total."""
    out = b""
    for name, _, _, body in iso_boxes(data):
        if name in _PROVENANCE_BOXES and len(out) < most:
            out += body[: most - len(out)]
    return out


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int] | None:
    if at >= len(data) or not data[at]:
        return None
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        return None
    value = int.from_bytes(data[at : at + width], "big")
    return (value if keep_marker else value & ((1 << (7 * width)) - 1)), width


# Elements that hold others (segment, tags, tag, simple tag), and a tag's name and text.
_EBML_MASTERS, _TAG_NAME, _TAG_STRING, _EBML_CLUSTER = (0x18538067, 0x1254C367, 0x7373, 0x67C8), 0x45A3, 0x4487, 0x1F43B675


def ebml_elements(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[Entry]:
    at, end = start, len(data) if end is None else end
    while at < end:
        name = _vint(data, at, True)
        size = _vint(data, at + name[1], False) if name else None
        if not name or not size:
            return
        head = name[1] + size[1]
        length = min(size[0], end - at - head) if size[0] != (1 << (7 * size[1])) - 1 else end - at - head
        yield f"{name[0]:x}", at, size[0], b"" if name[0] == _EBML_CLUSTER else data[at + head : at + head + min(length, BODY)]
        if name[0] in _EBML_MASTERS and depth < 8:
            yield from ebml_elements(data, at + head, at + head + length, depth + 1)
        at += head + length


def ebml_tags(data: bytes) -> Iterator[tuple[str, str]]:
    key = None
    for kind, _, _, body in ebml_elements(data):
        if int(kind, 16) == _TAG_NAME:
            key = body.decode("utf-8", "replace")
        elif int(kind, 16) == _TAG_STRING and key is not None:
            yield key, body.decode("utf-8", "replace")
            key = None


def amf_strings(data: bytes, at: int = 0, depth: int = 0, key: str = "", out: list | None = None) -> tuple[list[tuple[str, str]], int]:
    """Named strings of an AMF0 value, nesting bounded, and where the value ends."""
    out = [] if out is None else out
    if at >= len(data) or depth > 16:
        return out, len(data)
    kind = data[at]
    at += 1
    if kind == 0:
        return out, at + 8
    if kind == 1:
        return out, at + 1
    if kind in (2, 12):
        wide = 2 if kind == 2 else 4
        size = int.from_bytes(data[at : at + wide], "big")
        out.append((key, data[at + wide : at + wide + size].decode("utf-8", "replace")))
        return out, at + wide + size
    if kind in (3, 8):
        at += 4 * (kind == 8)
        while at + 2 <= len(data):
            size = int.from_bytes(data[at : at + 2], "big")
            name, at = data[at + 2 : at + 2 + size].decode("utf-8", "replace"), at + 2 + size
            if not size and data[at : at + 1] == b"\x09":
                return out, at + 1
            before = at
            out, at = amf_strings(data, at, depth + 1, name, out)
            if at <= before:
                return out, len(data)
        return out, len(data)
    if kind == 10:
        n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        for _ in range(min(n, 10_000)):
            if at >= len(data):
                break
            out, at = amf_strings(data, at, depth + 1, key, out)
        return out, at
    return out, at if kind in (5, 6) else len(data)


def flv_metadata(data: bytes) -> list[tuple[str, str]]:
    """Named strings of the script tags."""
    out: list[tuple[str, str]] = []
    at = int.from_bytes(data[5:9], "big") + 4 if data.startswith(b"FLV") else len(data)
    while at + 11 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 18:
            body = data[at + 11 : at + 11 + size]
            _, inner = amf_strings(body)
            out += amf_strings(body, inner)[0]
        at += 15 + size
    return out


# TIFF tags that carry names, and the pointers to further directories.
_TIFF_TAGS = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9003: "DateTimeOriginal", 0x9286: "UserComment", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor"}
_TIFF_POINTERS = (0x8769, 0x8825, 0xA005)
_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def exif(data: bytes) -> dict[str, str]:
    """Named values of a TIFF block; a directory is visited once, a count is clamped to the data."""
    data = data[6:] if data.startswith(b"Exif\0\0") else data
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return {}
    out: dict[str, str] = {}
    todo, seen = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo and len(seen) < 16:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        for k in range(count):
            e = at + 2 + 12 * k
            if e + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(order + "HHI", data, e)
            size = _TIFF_SIZES.get(kind, 0) * n
            place = e + 8 if size <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
            raw = data[place : place + min(size, 65536)]
            if tag in _TIFF_POINTERS and len(raw) >= 4:
                todo.append(struct.unpack_from(order + "I", raw)[0])
            elif tag in _TIFF_TAGS and raw:
                wide = tag in (0x9C9C, 0x9C9D)
                text = raw.decode("utf-16-le", "replace") if wide else raw[8:].decode("utf-8", "replace") if tag == 0x9286 else raw.decode("utf-8", "replace")
                out[_TIFF_TAGS[tag]] = text.strip("\0 ") if kind in (1, 2, 7) else str(struct.unpack_from(order + {3: "H", 4: "I"}.get(kind, "B"), raw)[0])
        nxt = at + 2 + 12 * count
        if nxt + 4 <= len(data):
            todo.append(struct.unpack_from(order + "I", data, nxt)[0] or at)
    return out


def metadata_region(data: bytes) -> bytes:
    """The bytes that can hold metadata, coded pixels cut out; the whole buffer where a walk finds nothing."""
    kind = sniff(data)
    if kind == "png":
        parts = [c.encode("latin-1") + body for c, _, _, body in png_chunks(data) if c not in ("IDAT", "fdAT")]
    elif kind == "jpeg":
        parts = [body for _, _, _, body in jpeg_segments(data)]
    elif kind in ("webp", "avi", "riff"):
        parts = [c.encode("latin-1") + body for c, _, _, body in riff_chunks(data) if c not in ("VP8 ", "VP8L", "ALPH", "ANMF", "movi")]
    elif kind == "isobmff":
        parts = [n.encode("latin-1", "replace") + body for n, _, _, body in iso_boxes(data) if "/" not in n and n not in ("mdat", "idat", "free")]
    else:
        return data
    return b"\n".join(parts) or data


def trailer(data: bytes, window: int = 65536) -> bytes:
    """What follows the container's end mark, from its last window bytes.

    An editor that leaves its mark behind the end may keep the value inside the scan: with its mark in the last half
    megabyte, all of that is kept.  A file without a known end gives its last window.
    """
    kind = sniff(data)
    last = data[max(0, len(data) - QUICK) :]
    if dims.SAMSUNG_MARKER.encode() in last and kind != "isobmff":
        return last
    if kind == "png":
        at = last.rfind(b"IEND\xae\x42\x60\x82")
        return (last[at + 8 :] if at >= 0 else last)[-window:]
    if kind == "jpeg":
        at = last.rfind(b"\xff\xd9")
        return (last[at + 2 :] if at >= 0 else last)[-window:]
    if kind in ("webp", "avi", "riff", "wav"):
        return data[max(8 + int.from_bytes(data[4:8], "little"), len(data) - window) :]
    return b"" if kind == "isobmff" else last[-window:]


def metadata_pairs(data: bytes) -> dict[str, str]:
    """Key-value metadata that a container spells itself."""
    kind = sniff(data)
    try:
        if kind == "png":
            return dict(png_text(data))
        if kind == "ebml":
            return dict(ebml_tags(data))
        if kind == "flv":
            return dict(flv_metadata(data))
        if kind in ("avi", "riff"):
            return {c: body.decode("utf-8", "replace").strip("\0") for k, at, size, _ in riff_chunks(data) if k == "LIST" and data[at + 8 : at + 12] == b"INFO" for c, _, _, body in riff_chunks(data, at + 12, at + 8 + size)}
    except (struct.error, IndexError, ValueError):
        return {}
    return {}


def exif_of(data: bytes) -> dict[str, str]:
    kind = sniff(data)
    try:
        if kind == "jpeg":
            return next((exif(body) for m, _, _, body in jpeg_segments(data) if m == "e1" and body.startswith(b"Exif")), {})
        if kind == "png":
            return next((exif(body) for c, _, _, body in png_chunks(data) if c == "eXIf"), {})
        if kind == "webp":
            return next((exif(body) for c, _, _, body in riff_chunks(data) if c == "EXIF"), {})
        return exif(data) if kind == "tiff" else {}
    except (struct.error, IndexError, ValueError):
        return {}


def tc260_payloads(data: bytes) -> list[str]:
    """Native label values of video containers: tags, INFO chunks, script data, and item lists of ISO files."""
    out = [v for k, v in metadata_pairs(data).items() if k.strip("\0").upper() == "AIGC"] if sniff(data) in ("ebml", "flv", "avi", "riff") else []
    if sniff(data) == "isobmff":
        out += [body[at:].decode("utf-8", "replace").strip("\0") for n, _, _, body in iso_boxes(data) if ("ilst" in n or "udta" in n) and (at := body.find(b'{"')) >= 0 and b"Label" in body]
    return list(dict.fromkeys(out))


def samsung_edit(data: bytes) -> int | None:
    """The editor's non-zero type, where its container is in the head or, behind that, in the tail."""
    for part in (data[:QUICK], data[max(QUICK, len(data) - QUICK) :]):
        if dims.SAMSUNG_MARKER.encode() in part and (m := re.search(rb'genAIType"\s*:\s*(-?[0-9]{1,9})', part)):
            return int(m.group(1)) or None
    return None

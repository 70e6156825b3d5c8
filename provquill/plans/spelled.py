"""Small files spelled byte by byte, one or more for every container that the walkers read."""

from __future__ import annotations

import struct
import zlib
from typing import Any


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*late: bytes, early: bytes = b"", pixels: bytes = b"\0\0") -> bytes:
    """A 1 x 1 gray image with chunks before and behind its pixels."""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + early + chunk(b"IDAT", pixels if len(pixels) > 2 else zlib.compress(pixels)) + b"".join(late) + chunk(b"IEND", b"")


def text_chunk(key: str, value: str, packed: bool = False) -> bytes:
    body = value.encode("latin-1")
    return chunk(b"zTXt", key.encode() + b"\0\0" + zlib.compress(body)) if packed else chunk(b"tEXt", key.encode() + b"\0" + body)


def tiny_png(*text: tuple[str, str]) -> bytes:
    return png(early=b"".join(text_chunk(k, v) for k, v in text))


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind + body


def riff(form: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = form + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tiff(tags: dict[int, str]) -> bytes:
    """A little-endian block of text tags."""
    entries, heap, at = b"", b"", 8 + 2 + 12 * len(tags) + 4
    for tag, text in tags.items():
        raw = text.encode() + b"\0"
        raw += b"\0" * max(0, 5 - len(raw))
        entries += struct.pack("<HHII", tag, 2, len(raw), at + len(heap))
        heap += raw
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + heap


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", 2 + len(body)) + body


def jpeg(*segments: bytes, scan: bytes = b"\x12" * 9, after: bytes = b"") -> bytes:
    """A JPEG with a 32 x 16 frame header, coded pixels and what follows the end mark."""
    return b"\xff\xd8" + b"".join(segments) + b"\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x00\x11\x00" + b"\xff\xda\x00\x02" + scan + b"\xff\xd9" + after


def ebml(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + bytes([0x40 | len(body) >> 8, len(body) & 255]) + body


def mkv(key: str, value: str) -> bytes:
    return ebml(0x1A45DFA3, b"") + ebml(0x18538067, ebml(0x1254C367, ebml(0x7373, ebml(0x67C8, ebml(0x45A3, key.encode()) + ebml(0x4487, value.encode())))))


def flv(key: str, value: str) -> bytes:
    body = b"\x02\x00\x0aonMetaData" + b"\x03" + struct.pack(">H", len(key)) + key.encode() + b"\x02" + struct.pack(">H", len(value)) + value.encode() + b"\x00\x00\x09"
    return b"FLV\x01\x05" + struct.pack(">I", 9) + b"\0" * 4 + b"\x12" + len(body).to_bytes(3, "big") + b"\0" * 7 + body + b"\0" * 4


def mp4(label: str, *more: bytes) -> bytes:
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"udta", box(b"meta", b"\0\0\0\0" + box(b"ilst", box(b"AIGC", label.encode()))))) + b"".join(more)


def avi(label: str) -> bytes:
    return riff(b"AVI ", (b"LIST", b"INFO" + b"AIGC" + struct.pack("<I", len(label)) + label.encode()))


def cbor(value: Any) -> bytes:
    """Definite CBOR of maps, lists, texts, bytes, numbers and truth values."""
    head = lambda major, n: bytes([major << 5 | n]) if n < 24 else bytes([major << 5 | 24, n]) if n < 256 else bytes([major << 5 | 25]) + struct.pack(">H", n)
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, (str, bytes)):
        raw = value.encode() if isinstance(value, str) else value
        return head(3 if isinstance(value, str) else 2, len(raw)) + raw
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(cbor(k) + cbor(v) for k, v in value.items())
    return head(4, len(value)) + b"".join(map(cbor, value))


def jumb(label: str, *content: bytes) -> bytes:
    return box(b"jumb", box(b"jumd", b"\0" * 16 + b"\x03" + label.encode() + b"\0") + b"".join(content))


def certificate(issuer: str, subject: str) -> bytes:
    """What a reader of organisations needs of a certificate: the issuer's name, then the subject's."""
    names = b"".join(bytes.fromhex("060355040a") + b"\x0c" + bytes([len(n)]) + n.encode() for n in (issuer, subject))
    return b"\x30\x82" + struct.pack(">H", len(names)) + names


def manifest(label: str, generator: str, signer: str, actions: list[dict], ingredient: str | None = None, failed: str | None = None) -> bytes:
    parts = [jumb("c2pa.actions", box(b"cbor", cbor({"actions": actions})))]
    if ingredient:
        parts.append(jumb("c2pa.ingredient.v2", box(b"cbor", cbor({"title": "parent", "c2pa_manifest": {"url": f"self#jumbf=/c2pa/{ingredient}"}, "validationStatus": [{"code": failed}] if failed else []}))))
    signature = cbor([cbor({33: certificate("A root", signer)}), {}, False, b"\0" * 64])
    return jumb(label, jumb("c2pa.assertions", *parts), jumb("c2pa.claim", box(b"cbor", cbor({"claim_generator": generator, "alg": "sha256"}))), jumb("c2pa.signature", box(b"cbor", b"\xd2" + signature)))


def store(*manifests: bytes) -> bytes:
    return jumb("c2pa", *manifests)


def app11(payload: bytes, piece: int = 400) -> list[bytes]:
    """The marker segments that carry a JUMBF box; every further one repeats the box's head."""
    cuts = [payload[:piece], *(payload[k : k + piece] for k in range(piece, len(payload), piece))]
    return [segment(0xEB, b"JP\0\1" + struct.pack(">I", k + 1) + (b"" if k == 0 else payload[:8]) + part) for k, part in enumerate(cuts)]


def uuid_box(payload: bytes) -> bytes:
    return box(b"uuid", bytes.fromhex("d8fec3d61b0e483c92975828877ec481") + b"\0" * 4 + b"manifest\0" + b"\0" * 8 + payload)


LABEL = '{"Label":"1","ContentProducer":"001X"}'
XMP = "<x:xmpmeta><Iptc4xmpExt:DigitalSourceType>trainedAlgorithmicMedia</Iptc4xmpExt:DigitalSourceType></x:xmpmeta>"
MADE = [{"action": "c2pa.created", "digitalSourceType": "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia", "softwareAgent": {"name": "GPT-4o"}}, {"action": "c2pa.converted"}]
EDITED = [{"action": "c2pa.edited"}]
_PARENT = manifest("urn:uuid:parent", "an editor", "Adobe Inc.", EDITED)
_LIAR = manifest("urn:uuid:liar", "Firefly", "Google LLC", MADE)
STORE = store(_PARENT, _LIAR, manifest("urn:uuid:active", "ChatGPT", "OpenAI OpCo", MADE, "urn:uuid:parent"))
BROKEN = store(_LIAR, manifest("urn:uuid:active", "a camera", "NoOne", EDITED, "urn:uuid:liar", "claimSignature.mismatch"))
SAMSUNG = b'PhotoEditor_Re_Edit_Data{"genAIType" : 2}'
#: Coded bytes longer than the head window that the queries walk these files with.
LONG, HEAD = b"\x55" * 700, 512

#: (name, bytes); the order is that of the queries' SQL.
FILES = (
    ("parameters", tiny_png(("parameters", "a cat, steps 20"))),
    ("plain", tiny_png(("Title", "holiday"))),
    ("software", tiny_png(("Software", "Midjourney v6"))),
    ("bare_jpeg", b"\xff\xd8\xff\xe1\x00\x0aExif\0\0II\xff\xd9"),
    ("empty", b""),
    ("png_late", png(chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + XMP.encode()), pixels=LONG)),
    ("png_packed", png(early=text_chunk("Comment", XMP, packed=True))),
    ("png_store", png(early=chunk(b"caBX", STORE))),
    ("jpeg_exif", jpeg(segment(0xE1, b"Exif\0\0" + tiff({0x0131: "Stable Diffusion", 0x010F: "x"})))),
    ("jpeg_store", jpeg(*app11(STORE))),
    ("jpeg_broken", jpeg(*app11(BROKEN))),
    ("jpeg_noise", jpeg(*app11(store(manifest("urn:uuid:n", "a camera", "NoOne", EDITED))), scan=b"\x12\x34Bria\x56")),
    ("jpeg_samsung", jpeg(scan=LONG, after=SAMSUNG)),
    ("webp_late", riff(b"WEBP", (b"VP8 ", LONG), (b"EXIF", tiff({0x013B: "someone"})), (b"XMP ", XMP.encode()))),
    ("webp_noise", riff(b"WEBP", (b"VP8 ", b"trainedAlgorithmicMedia jumb c2pa Bria"), (b"EXIF", tiff({0x013B: "someone"})))),
    ("avi", avi(LABEL)),
    ("mp4", mp4(LABEL, box(b"mdat", LONG))),
    ("mp4_store", mp4("", box(b"mdat", LONG), uuid_box(STORE))),
    ("mkv", mkv("AIGC", LABEL)),
    ("flv", flv("AIGC", LABEL)),
)

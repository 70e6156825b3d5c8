"""Container walkers on spelled files, and truncation fuzz: a walker never raises."""

from __future__ import annotations

import io
import random
import struct

import pytest

from provquill.plans import spelled as S
from provquill.plans.spelled import LABEL, chunk, png, riff, text_chunk, tiff, tiny_png
from provquill.sources import credentials, files
from provquill.sources import walkers as W
from provquill.sources.ranged import BLOCK, Ranged

SOFTWARE, ARTIST = 0x0131, 0x013B
JPEG = S.jpeg(S.segment(0xE1, b"Exif\0\0" + tiff({SOFTWARE: "Midjourney"})), after=b"trailing")
MP4 = S.mp4(LABEL, S.box(b"uuid", b"provenance"))
FILES = {"png": tiny_png(("parameters", "x")), "jpeg": JPEG, "webp": riff(b"WEBP", (b"VP8 ", b"abc"), (b"EXIF", tiff({ARTIST: "someone"}))), "avi": S.avi(LABEL), "isobmff": MP4, "ebml": S.mkv("AIGC", LABEL), "flv": S.flv("AIGC", LABEL)}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_sniff(kind):
    assert W.sniff(FILES[kind]) == kind


def test_png_text_and_trailer():
    packed = png(text_chunk("Comment", "hidden", packed=True), early=text_chunk("parameters", "a cat")) + b"after"
    assert dict(W.png_text(packed)) == {"parameters": "a cat", "Comment": "hidden"}
    assert W.trailer(packed) == b"after"
    assert b"IDAT" not in W.metadata_region(packed)


def test_jpeg():
    assert W.exif_of(JPEG) == {"Software": "Midjourney"}
    assert W.jpeg_tables(JPEG)["width"] == 32
    assert W.jpeg_tables(JPEG)["height"] == 16
    assert W.trailer(JPEG) == b"trailing"


@pytest.mark.parametrize("kind", ["avi", "ebml", "flv", "isobmff"])
def test_native_labels(kind):
    assert W.tc260_payloads(FILES[kind]) == [LABEL]


def test_iso_and_webp():
    assert W.iso_provenance(MP4) == b"provenance"
    assert [n for n, *_ in W.iso_boxes(MP4)][:3] == ["ftyp", "moov", "moov/udta"]
    assert W.exif_of(FILES["webp"]) == {"Artist": "someone"}
    assert b"abc" not in W.metadata_region(FILES["webp"])


def test_huge_lengths_are_clamped():
    assert list(W.png_chunks(W.PNG + b"\xff\xff\xff\xfftEXtab")) == []
    assert list(W.iso_boxes(struct.pack(">I", 1) + b"uuid" + b"\xff" * 8 + b"x"))[0][3] == b"x"


@pytest.mark.parametrize("kind", sorted(FILES))
def test_truncation_and_noise_never_raise(kind):
    r, data = random.Random(1), FILES[kind]
    for _ in range(300):
        b = bytearray(data[: r.randint(0, len(data))])
        for _ in range(r.randint(0, 3)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        for f in (W.metadata_region, W.metadata_pairs, W.exif_of, W.tc260_payloads, W.trailer, W.jpeg_tables, W.sniff):
            f(bytes(b))


def test_inventories_keep_every_entry(spark):
    import json
    import struct
    import zlib

    from provquill.sources import files, sinks

    chunk = lambda kind: struct.pack(">I", 0) + kind + struct.pack(">I", zlib.crc32(kind))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt") * 10_049 + chunk(b"IEND")
    df = spark.createDataFrame([("a.png", data)], "path string, content binary")
    assert files.walk(df).selectExpr("size(entries) AS n").first().n == 10_050
    assert len(json.loads(sinks.forensic_records(df).first().record)["entries"]) == 10_050


def test_stores():
    for data in (png(early=chunk(b"caBX", S.STORE)), S.jpeg(*S.app11(S.STORE)), riff(b"WEBP", (b"C2PA", S.STORE)), S.mp4(LABEL, S.uuid_box(S.STORE))):
        store = credentials.store_of(credentials.store_bytes(data))
        assert store["active_manifest"] == "urn:uuid:active" and len(store["manifests"]) == 3
        found = credentials.summary(store)
        assert (found["issuer"], found["claim_generator"], found["source_kind"], found["identity_ai"]) == ("OpenAI, Adobe", "ChatGPT", "generated", True)
    broken = credentials.store_of(S.BROKEN)
    assert [m["claim_generator"] for m in credentials.chain(broken)] == ["a camera"] and credentials.summary(broken)["source_kind"] is None
    assert credentials.store_bytes(JPEG) == b"" and credentials.store_of(b"") is None


def test_damaged_stores_never_raise():
    r = random.Random(2)
    for _ in range(1500):
        b = bytearray(S.STORE[: r.randint(0, len(S.STORE))] if r.random() < 0.5 else S.STORE)
        for _ in range(r.randint(0, 4)):
            if b:
                b[r.randrange(len(b))] = r.randrange(256)
        store = credentials.store_of(bytes(b))
        assert store is None or credentials.summary(store)


def test_cbor_values():
    value = {"a": [1, -5, 300, "text", True, False], "b": {"c": b"raw"}, "long": "x" * 300}
    assert credentials.cbor(S.cbor(value)) == (value, len(S.cbor(value)))
    assert credentials.cbor(b"\x9f\x01\x7f\x61a\x61b\xff\xff")[0] == [1, "ab"] and credentials.cbor(b"\xf9\x3c\x00")[0] == 1.0
    for bad in (b"", b"\x5a\xff\xff\xff\xff", b"\x81" * 100, b"\x1c"):
        with pytest.raises(credentials.Malformed):
            credentials.cbor(bad)


def test_ranged_reads_what_bytes_give():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(3 * BLOCK + 77))
    lazy = Ranged(io.BytesIO(data), len(data), kept=2)
    for _ in range(300):
        a, b = r.randint(-50, len(data) + 50), r.randint(-50, len(data) + 50)
        assert lazy[a:b] == data[a:b]
    assert lazy[5] == data[5] and lazy[-1] == data[-1] and lazy.startswith(data[:9]) and lazy.rfind(data[-BLOCK - 9 : -BLOCK]) == data.rfind(data[-BLOCK - 9 : -BLOCK])


def test_heads_give_what_whole_files_give(spark, tmp_path):
    """The same rows, but for the hash, from ranges of large files: pixels in between are not read."""
    for name, data in S.FILES:
        (tmp_path / f"{name}.{ {'png': 'png', 'jpeg': 'jpg', 'webp': 'webp', 'avi': 'avi', 'isobmff': 'mp4', 'ebml': 'mkv', 'flv': 'flv'}.get(W.sniff(data), 'png')}").write_bytes(data)
    big = png(text_chunk("parameters", "late"), pixels=b"\x55" * (40 * BLOCK))
    (tmp_path / "big.png").write_bytes(big)
    columns = [c for c in files.walk_heads(spark, str(tmp_path)).columns if c != "sha256"]
    whole, heads = (sorted(str(r) for r in w.select(columns).collect()) for w in (files.walk(files.read_files(spark, str(tmp_path))), files.walk_heads(spark, str(tmp_path))))
    assert len(heads) >= len(S.FILES) and [x for x in heads if "empty" not in x] == whole
    lazy = Ranged(io.BytesIO(big), len(big))
    files._walked("x", lazy, 1000, files.T.Finder())
    assert lazy.bytes_read <= 17 * BLOCK < len(big)  # the first and the last half megabyte, and the heads of chunks


def test_bad_records_raise(spark):
    for text in ('{"record_type":"metadata","schema_version":2,"status":"complete"}', '{"record_type":"metadata","schema_version":1,"status":"partial"}', '{"record_type":"pixels"}', "[]", None):
        with pytest.raises(Exception, match="BadRecord"):
            files.walk_records(spark.createDataFrame([("x", text)], "path string, record string")).collect()

"""Credential stores inside files: JUMBF boxes and CBOR values read into the store's JSON form.

A store is a JUMBF superbox of manifests; a manifest holds a claim, assertions and a signature.  Hashes and
signatures are not checked here, so such a store has no status codes and its dimensions stay unknown.  Readers are
pure functions on bytes that never raise and never trust a length.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

from ..operators import dims
from . import walkers

# The UUID of a provenance box in ISO files, the chunk that holds a store in PNG, in RIFF, and the JPEG marker.
UUID = bytes.fromhex("d8fec3d61b0e483c92975828877ec481")
PNG_CHUNK, RIFF_CHUNK, JPEG_MARKER = "caBX", "C2PA", "eb"
# Fixed value: the object identifier of an organisation's name in a certificate.
_ORGANISATION = bytes.fromhex("060355040a")
#: Nesting that is followed in boxes and values.
DEPTH = 32


class Malformed(ValueError):
    pass


def cbor(data: bytes, at: int = 0, depth: int = 0) -> tuple[Any, int]:
    """A CBOR value and where it ends; tags are dropped, byte strings stay bytes."""
    if at >= len(data) or depth > DEPTH:
        raise Malformed
    major, low = data[at] >> 5, data[at] & 31
    at += 1
    size = {24: 1, 25: 2, 26: 4, 27: 8}.get(low, 0)
    if at + size > len(data) or 28 <= low <= 30:
        raise Malformed
    number = int.from_bytes(data[at : at + size], "big") if size else low
    raw, at = data[at : at + size], at + size
    endless = low == 31
    if major == 0:
        return number, at
    if major == 1:
        return -1 - number, at
    if major in (2, 3):
        parts = []
        if endless:
            while data[at : at + 1] != b"\xff":
                part, at = cbor(data, at, depth + 1)
                parts.append(part if isinstance(part, bytes) else str(part).encode())
            at += 1
        else:
            if at + number > len(data):
                raise Malformed
            parts, at = [data[at : at + number]], at + number
        value = b"".join(parts)
        return (value if major == 2 else value.decode("utf-8", "replace")), at
    if major in (4, 5):
        items: list = []
        left = number * (major - 3)
        while data[at : at + 1] != b"\xff" if endless else left > 0:
            item, at = cbor(data, at, depth + 1)
            items.append(item)
            left -= 1
        at += endless
        return (items if major == 4 else {str(k): v for k, v in zip(items[::2], items[1::2], strict=False)}), at
    if major == 6:
        return cbor(data, at, depth + 1)
    if size in (2, 4, 8):
        return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], raw)[0], at
    return {20: False, 21: True}.get(number), at


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(kind, first byte of the body, end) of the boxes in a range."""
    while start + 8 <= end:
        size, kind, head = int.from_bytes(data[start : start + 4], "big"), data[start + 4 : start + 8].decode("latin-1"), 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        size = size or end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def superbox(data: bytes, start: int, end: int) -> tuple[str, list[tuple[str, int, int]]]:
    """The label of a superbox, and the boxes behind its description."""
    inner = list(boxes(data, start, end))
    if not inner or inner[0][0] != "jumd":
        raise Malformed
    _, at, stop = inner[0]
    described = data[at + 17 : stop] if data[at + 16 : at + 17] and data[at + 16] & 2 else b""
    return described.split(b"\0", 1)[0].decode("utf-8", "replace"), inner[1:]


def _content(data: bytes, parts: list[tuple[str, int, int]]) -> Any:
    """The value of the first CBOR or JSON box."""
    for kind, at, end in parts:
        if kind == "cbor":
            return cbor(data[at:end])[0]
        if kind == "json":
            return json.loads(data[at:end])
    return None


def organisation(certificate: bytes) -> str | None:
    """The organisation of a certificate's subject, which stands behind its issuer's."""
    found, at = [], certificate.find(_ORGANISATION)
    while at >= 0:
        body = at + len(_ORGANISATION)
        size = certificate[body + 1] if body + 1 < len(certificate) else 0
        if size < 128:
            found.append(certificate[body + 2 : body + 2 + size].decode("utf-8", "replace"))
        at = certificate.find(_ORGANISATION, body)
    return found[-1] if found else None


def _signer(signature: Any) -> str | None:
    """The signer's organisation, from the first certificate among a signature's headers."""
    todo = [signature]
    while todo:
        x = todo.pop(0)
        if isinstance(x, bytes):
            if x[:2] == b"\x30\x82" and (name := organisation(x)):
                return name
            if x[:1] and x[0] >> 5 == 5:  # protected headers are a map inside a byte string
                try:
                    todo.insert(0, cbor(x)[0])
                except Malformed:
                    continue
        elif isinstance(x, (list, dict)):
            todo = [*(x.values() if isinstance(x, dict) else x), *todo]
    return None


def _label_of(url: Any) -> str | None:
    """The manifest that a JUMBF reference names."""
    parts = str(url).partition("jumbf=")[2].strip("/").split("/") if url else []
    return parts[1] if len(parts) > 1 and parts[0] == "c2pa" else None


def _plain(value: Any) -> Any:
    """The value without byte strings, which JSON cannot hold."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items() if not isinstance(v, bytes)}
    return [_plain(v) for v in value if not isinstance(v, bytes)] if isinstance(value, list) else value


def _manifest(data: bytes, parts: list[tuple[str, int, int]]) -> dict:
    out: dict = {"assertions": [], "ingredients": []}
    for kind, at, end in parts:
        if kind != "jumb":
            continue
        try:
            label, inner = superbox(data, at, end)
            if label == "c2pa.assertions":
                for k, a, e in inner:
                    if k == "jumb":
                        name, content = superbox(data, a, e)
                        value = _plain(_content(data, content))
                        if name.startswith("c2pa.ingredient") and isinstance(value, dict):
                            target = value.get("activeManifest") or value.get("c2pa_manifest") or {}
                            out["ingredients"].append({"active_manifest": _label_of(target.get("url")) if isinstance(target, dict) else None, "validation_status": value.get("validationStatus") or []})
                        elif value is not None:
                            out["assertions"].append({"label": name, "data": value})
            elif label.startswith("c2pa.claim"):
                claim = _content(data, inner)
                info = claim.get("claim_generator_info")
                out |= {"claim_generator": claim.get("claim_generator"), "claim_generator_info": _plain(info if isinstance(info, list) else [info] if info else [])}
            elif label.startswith("c2pa.signature"):
                out["signature_info"] = {"issuer": _signer(_content(data, inner))}
        except (ValueError, AttributeError, TypeError, IndexError, RecursionError):  # this part is unreadable; the others are read
            continue
    return out


def store_of(payload: bytes) -> dict | None:
    """A store from its JUMBF bytes: its manifests by label, the last one active; null where there is none."""
    try:
        for kind, at, end in boxes(payload, 0, len(payload)):
            if kind != "jumb":
                continue
            label, parts = superbox(payload, at, end)
            if label != "c2pa":
                continue
            manifests = {}
            for k, a, e in parts:
                if k == "jumb":
                    name, inner = superbox(payload, a, e)
                    manifests[name] = _manifest(payload, inner)
            return {"active_manifest": list(manifests)[-1], "manifests": manifests} if manifests else None
    except Malformed:
        return None
    return None


def store_bytes(data: bytes) -> bytes:
    """The JUMBF bytes of a file's store, from wherever its container keeps it; empty for none."""
    kind = walkers.sniff(data)
    if kind == "png":
        return next((data[at + 8 : at + 8 + n] for c, at, n, _ in walkers.png_chunks(data) if c == PNG_CHUNK), b"")
    if kind == "jpeg":
        parts: dict[bytes, list[tuple[int, bytes]]] = {}
        for marker, at, n, _ in walkers.jpeg_segments(data):
            body = data[at + 4 : at + 2 + n]
            if marker == JPEG_MARKER and body[:2] == b"JP" and len(body) > 16:
                parts.setdefault(body[2:4], []).append((int.from_bytes(body[4:8], "big"), body))
        for numbered in parts.values():  # a box goes on in further segments, which repeat its head
            joined = b"".join(b[8:] if k == 0 else b[16:] for k, (_, b) in enumerate(sorted(numbered)))
            if b"c2pa" in joined[:128]:
                return joined
        return b""
    if kind in ("webp", "avi", "wav", "riff"):
        return next((data[at + 8 : at + 8 + n] for c, at, n, _ in walkers.riff_chunks(data) if c == RIFF_CHUNK), b"")
    if kind == "isobmff":
        for name, at, n, _ in walkers.iso_boxes(data):
            body = data[at + 8 : at + n]
            if name == "uuid" and body.startswith(UUID):
                purpose, _, rest = body[20:].partition(b"\0")
                return rest[8:] if purpose == b"manifest" else b""
    return b""


def _get(holder: Any, key: str, kind: type) -> Any:
    """A member of the wanted type, or an empty one."""
    value = holder.get(key) if isinstance(holder, dict) else None
    return value if isinstance(value, kind) else kind()


def _codes(holder: Any, key: str) -> list[str]:
    return [code for x in _get(holder, key, list) if (code := _get(x, "code", str))]


def _bad(ingredient: Any) -> bool:
    """Whether an ingredient's own status says that its content or signature does not hold."""
    results = _get(_get(ingredient, "validation_results", dict), "activeManifest", dict)
    named = any(_codes(results, s) for s in ("success", "informational", "failure"))
    failed = _codes(results, "failure") if named else _codes(ingredient, "validation_status")
    return any(c in dims.SIGNATURE_FAILURES or any(m in c for m in dims.BINDING_FAILURES) for c in failed)


def chain(store: dict) -> list[dict]:
    """The active manifest and the usable ingredients that it reaches, nearest first."""
    manifests = _get(store, "manifests", dict)
    todo, seen, out = [_get(store, "active_manifest", str)], set(), []
    while todo:
        label = todo.pop(0)
        if label in seen or not isinstance(manifests.get(label), dict):
            continue
        seen.add(label)
        out.append(manifests[label])
        todo += [_get(i, "active_manifest", str) for i in _get(manifests[label], "ingredients", list) if not _bad(i)]
    return out


def _first_labels(texts: list[str], pairs: tuple[tuple[str, str], ...]) -> list[str]:
    return list(dict.fromkeys(label for text in texts for token, label in pairs if token in text))


def summary(store: dict) -> dict:
    """What a store's usable chain says: see SUMMARY; empty texts are null."""
    found = chain(store)
    names = [[_get(m, "claim_generator", str), *(_get(g, "name", str) for g in _get(m, "claim_generator_info", list))] for m in found]
    generators = [[x for x in own if x] for own in names]
    assertions = [(_get(a, "label", str), _get(a, "data", dict)) for m in found for a in _get(m, "assertions", list)]
    acts = [x for label, d in assertions if label.startswith("c2pa.actions") for x in _get(d, "actions", list)]
    agents = [_get(_get(x, "softwareAgent", dict), "name", str) for x in acts]
    kinds = [_get(x, "digitalSourceType", str) for x in acts]
    signers = [v for m in found for v in _get(m, "signature_info", dict).values() if isinstance(v, str)]
    done = list(dict.fromkeys(a.removeprefix("c2pa.") for x in acts if (a := _get(x, "action", str))))
    composite = [k for k in kinds if "compositeWithTrainedAlgorithmicMedia" in k]
    trained = [k for k in kinds if "trainedAlgorithmicMedia" in k and k not in composite]
    own_tools = _first_labels([g for own in generators for g in own], dims.AI_TOOLS)
    text = json.dumps(found, ensure_ascii=False)
    vendors = sorted({v.org for v in dims.VENDORS if v.synthid and v.token in text and (not v.needs_watermark_action or any(d.startswith("watermarked") for d in done))}) if trained or composite else []
    return {
        "issuer": ", ".join(_first_labels(signers, tuple((v.token, v.org) for v in dims.VENDORS))) or None,
        "claim_generator": next(iter(generators[0]), None) if generators else None,
        "ai_tool": ", ".join(dict.fromkeys([*own_tools, *_first_labels(agents, dims.AI_TOOLS)])) or None,
        "actions": ", ".join(done) or None,
        "source_type": "trainedAlgorithmicMedia (AI-generated)" if trained else "compositeWithTrainedAlgorithmicMedia (AI-enhanced)" if composite else "algorithmicMedia" if any("algorithmicMedia" in k for k in kinds) else None,
        "source_kind": "generated" if trained else "enhanced" if composite else None,
        "identity_ai": bool(own_tools),
        "synthid": f"present according to {', '.join(vendors)} provenance" if vendors else None,
        "soft_binding": ", ".join(sorted(set(_first_labels([_get(d, "alg", str) for label, d in assertions if label.startswith("c2pa.soft-binding")], dims.SOFT_BINDINGS)))) or None,
    }


#: The type of summary() in a frame.
SUMMARY = "struct<issuer:string,claim_generator:string,ai_tool:string,actions:string,source_type:string,source_kind:string,identity_ai:boolean,synthid:string,soft_binding:string>"

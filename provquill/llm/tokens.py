"""Token ids of whole texts by the tokenizers library, with a worker-side cache of words.

Both public vocabularies split a text into words before any merge, and no word crosses a single blank or newline
between two visible characters.  So texts are cut there by Arrow, equal pieces of a batch are found once, the
library encodes each distinct piece, and a text's ids are gathered from the pieces' ids.  Texts where a blank is
not such a boundary (runs of white space, tabs and other white space) are encoded whole.  The tests compare both
ways on random texts.
"""

from __future__ import annotations

import re
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_state

#: Pieces kept per worker and vocabulary; later ones are encoded batch by batch.
CACHE_PIECES = 500_000

#: White space other than plain blanks and newlines; a piece with any sends its text the whole way.
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


class Encoder:
    """Ids of texts; whether the vocabulary drops white space is found from its normalizer."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = self.tokenizer.normalizer is not None
        self.cache_pieces = cache_pieces
        self.cache: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's own encoding of each text as little-endian unsigned 32-bit ids; nothing is cut or kept."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces, encoded as one text with a mark between them whose id no piece yields."""
        mark, mark_id = ("<|startoftext|>", 49406) if self.drops_space else ("\n", 198)
        if any(mark in p for p in pieces) if self.drops_space else "\n" in pieces:
            rest = [p for p in pieces if mark in p]
            found = dict(zip(rest, self.whole(rest), strict=True))
            plain = [p for p in pieces if mark not in p]
            found |= dict(zip(plain, self._apart(plain), strict=True)) if plain else {}
            return [found[p] for p in pieces]
        out: list[bytes] = []
        chunks = [pieces[k : k + 256] for k in range(0, len(pieces), 256)]  # short texts keep the library's tables in cache
        for chunk, e in zip(chunks, self.tokenizer.encode_batch_fast([mark.join(["", *c, ""]) for c in chunks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == mark_id)
            raw, at = ids.tobytes(), (ends * 4).tolist()
            out += [raw[s + 4 : e] for s, e in zip(at[:-1], at[1:], strict=True)] if len(ends) == len(chunk) + 1 else self.whole(chunk)
        return out

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if self.drops_space:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of every text of a batch, as little-endian unsigned 32-bit; a null text has none."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return []
        cut = self._cut(texts)
        flat = cut.flatten().dictionary_encode()
        index, pieces = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        odd = np.zeros(len(pieces), dtype=bool)
        if not self.drops_space:
            odd[[pieces.index(p) for p in ("", " ") if p in pieces]] = True
        if _OTHER_SPACE.search("".join(pieces)):
            odd |= np.fromiter((_OTHER_SPACE.search(p) is not None for p in pieces), dtype=bool, count=len(pieces))
        found = list(map(self.cache.get, pieces))
        missing = [k for k, f in enumerate(found) if f is None]
        if missing:
            names = [pieces[k] for k in missing]
            ids = self._apart(names)
            for k, x in zip(missing, ids, strict=True):
                found[k] = x
            if len(self.cache) < self.cache_pieces:
                self.cache.update(zip(names[: self.cache_pieces - len(self.cache)], ids, strict=False))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        table = np.frombuffer(b"".join(found), dtype="<u4")
        firsts = np.cumsum(sizes) - sizes
        counts = sizes[index]
        ends = np.cumsum(counts)
        raw = table[np.repeat(firsts[index] - (ends - counts), counts) + np.arange(ends[-1])].tobytes() if len(ends) else b""
        bounds = (np.concatenate(([0], ends))[at] * 4).tolist()
        out = [raw[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        irregular = np.diff(np.concatenate(([0], np.cumsum(odd[index])))[at]) > 0
        if not self.drops_space:
            irregular |= pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        if irregular.any():
            which = np.flatnonzero(irregular).tolist()
            for k, ids in zip(which, self.whole([texts[k].as_py() for k in which]), strict=True):
                out[k] = ids
        return out


def encoder(path: str) -> Any:
    """The worker's encoder for a vocabulary file; single-threaded, as Spark gives each task one core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_state(f"encoder:{path}", lambda: Encoder(path))

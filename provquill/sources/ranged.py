"""A file as a sequence of bytes of which only the blocks that are looked at are read."""

from __future__ import annotations

from collections import OrderedDict
from typing import Any

BLOCK = 1 << 16


class Ranged:
    """What the walkers use of bytes (length, slices, one byte, a prefix test, a search from the end) over a seekable file."""

    def __init__(self, handle: Any, size: int, kept: int = 64) -> None:
        self.handle, self.size, self.kept = handle, size, kept
        self.blocks: OrderedDict[int, bytes] = OrderedDict()
        self.bytes_read = 0

    def _block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.handle.seek(k * BLOCK)
            self.blocks[k] = self.handle.read(min(BLOCK, self.size - k * BLOCK))
            self.bytes_read += len(self.blocks[k])
            if len(self.blocks) > self.kept:
                self.blocks.popitem(last=False)
        return self.blocks[k]

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: int | slice) -> Any:
        if isinstance(at, int):
            at = at + self.size if at < 0 else at
            if not 0 <= at < self.size:
                raise IndexError(at)
            return self._block(at // BLOCK)[at % BLOCK]
        start, stop, _ = at.indices(self.size)
        if stop <= start:
            return b""
        joined = b"".join(self._block(k) for k in range(start // BLOCK, (stop - 1) // BLOCK + 1))
        first = start // BLOCK * BLOCK
        return joined[start - first : stop - first]

    def startswith(self, prefix: bytes) -> bool:
        return self[: len(prefix)] == prefix

    def rfind(self, needle: bytes) -> int:
        end = self.size
        while end > 0:
            start = max(0, end - BLOCK)
            found = self[start : min(self.size, end + len(needle) - 1)].rfind(needle)
            if found >= 0:
                return start + found
            end = start
        return -1

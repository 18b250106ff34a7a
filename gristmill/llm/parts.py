"""Records of one task in parts that fit its memory, however many there are.

Records are rows of numpy structured arrays.  Up to ``LIMIT`` bytes of them stay in memory; more
are dealt by the bits of their keys into temporary files without a name, which are gone with the
task, and those are read one after the other.  Records of one key are never parted.
"""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of records in memory at once, and of those read from a file in one go.
LIMIT, BLOCK = 1 << 24, 1 << 21
#: Bits of the key that choose a file.
BITS = 4


class Heap:
    """Records to be read block by block and as often as needed: in a temporary file, if they are many."""

    def __init__(self, kind: np.dtype) -> None:
        self.file, self.kind, self.size = tempfile.SpooledTemporaryFile(BLOCK >> 3), kind, 0
        self.least, self.most = None, None

    def add(self, records: np.ndarray, keys: np.ndarray | None = None) -> None:
        if keys is not None:
            least, most = keys.min(), keys.max()
            self.least = least if self.least is None else min(self.least, least)
            self.most = most if self.most is None else max(self.most, most)
        self.size += self.file.write(records.tobytes())

    def blocks(self) -> Iterator[np.ndarray]:
        self.file.seek(0)
        while data := self.file.read(max(1, BLOCK // self.kind.itemsize) * self.kind.itemsize):
            yield np.frombuffer(data, dtype=self.kind)

    def whole(self) -> np.ndarray:
        return np.concatenate(list(self.blocks()))


def parts(
    blocks: Iterable[np.ndarray], key: Callable[[np.ndarray], np.ndarray], limit: int | None = None, shift: int = 64 - BITS,
) -> Iterator[np.ndarray | Heap]:
    """Parts of the records, each with every record of its keys; a ``Heap`` is a single key of more than ``limit`` bytes.

    ``key`` gives 64 bits for each record.  A part is to be used before the next one is taken.
    """
    limit = limit or LIMIT
    held, size = [], 0
    heaps: dict[int, Heap] = {}

    def deal() -> None:
        for block in held:
            keys = key(block)
            digit = (keys >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
            order = np.argsort(digit, kind="stable")
            edges = np.searchsorted(digit[order], np.arange((1 << BITS) + 1, dtype=np.uint64))
            for d in range(1 << BITS):
                own = order[edges[d]:edges[d + 1]]
                if len(own):
                    if d not in heaps:
                        heaps[d] = Heap(block.dtype)
                    heaps[d].add(block[own], keys[own])

    for block in blocks:
        held.append(block)
        size += block.nbytes
        if size > limit:
            deal()
            held, size = [], 0
    if not heaps:
        if held:
            yield np.concatenate(held)
        return
    deal()
    held = []
    for d in sorted(heaps):
        heap = heaps.pop(d)
        with heap.file:
            if heap.size <= limit:
                yield heap.whole()
            elif heap.least == heap.most:
                yield heap
            else:
                yield from parts(heap.blocks(), key, limit, shift - BITS)

"""Caches of Python workers: one at a time, bounded by bytes.

Spark keeps Python workers for the tasks that follow, of other operators too, so what a task leaves in a
module stays in the worker's memory. A worker here keeps the cache of the operator it works for and
drops it when another one asks.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa

#: Bytes of a worker's cached words, by estimate.
CACHE_BYTES = 32 << 20
#: What an entry takes besides the bytes of its word and value: two objects and its place.
ENTRY_BYTES = 170

_kept: dict[Any, Any] = {}


def kept_by_worker(key: Any, make: Callable[[], Any]) -> Any:
    """What this worker process has for ``key``; the first call for another key drops what it had before."""
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _kept[key] = make()
    return _kept[key]


class WordCache:
    """Values of words in two generations of half of ``limit`` bytes each: when the young one is full it
    becomes the old one, and what is asked for again moves back, so frequent words stay."""

    def __init__(self, limit: int = CACHE_BYTES) -> None:
        self.young: dict[bytes, Any] = {}
        self.old: dict[bytes, Any] = {}
        self.half, self.size = limit // 2, 0

    def values(self, words: Iterable[bytes], make: Callable[[bytes], Any]) -> list[Any]:
        """The words' values, those not known from ``make``."""
        words = list(words)
        found = list(map(self.young.get, words))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.value(words[i], make)
        return found

    def value(self, word: bytes, make: Callable[[bytes], Any]) -> Any:
        value = self.young.get(word)
        if value is None:
            value = self.old.get(word)
            if value is None:
                value = make(word)
            self.young[word] = value
            self.size += ENTRY_BYTES + len(word)
            if self.size > self.half:
                self.young, self.old, self.size = {}, self.young, 0
        return value

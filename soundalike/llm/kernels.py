"""Array helpers for blocks of texts inside a task: word hashes, windows of words, blocks of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from soundalike.llm.common import per_process

#: Texts are worked on in blocks of about so many characters, long ones in pieces of so many bytes.
BLOCK = 1_000_000
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _make_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, "u8"), np.full(size, _BASE_INVERSE, "u8")
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    return up, down


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of them."""
    if n > 2 * PIECE:
        return _make_powers(n)
    return per_process("powers", lambda: _make_powers(2 * PIECE))


def _piece_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start bytes of the words in ``data``, which ends in white space."""
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, "u8")
    total[0] = 0
    np.cumsum((data.astype("u8") + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), start


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(texts), "i8")
    held, size, first = [], 0, 0

    def flush(upto: int) -> None:
        nonlocal held, size, first
        if held:
            data = np.frombuffer(b"".join(held), "u1")
            found, start = _piece_words(data)
            ends = np.cumsum([len(x) for x in held])
            counts[first:upto] += np.diff(np.searchsorted(start, ends), prepend=0)
            hashes.append(found)
        held, size, first = [], 0, upto

    for i, text in enumerate(texts):
        data = text.encode("utf-8") + b"\n"
        if len(data) > PIECE:
            flush(i)
            bytes_ = np.frombuffer(data, "u1")
            at = 0
            while at < len(data):  # pieces end in white space, so no word is cut
                cut = min(len(data), at + PIECE)
                while not _SPACE[bytes_[cut - 1]]:
                    cut += 1
                found, _ = _piece_words(bytes_[at:cut])
                counts[i] += len(found)
                hashes.append(found)
                at = cut
            first = i + 1
            continue
        if size + len(data) > PIECE:
            flush(i)
        held.append(data)
        size += len(data)
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, "u8")), counts


def full_windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` words inside one text each: their hashes, first words and texts."""
    many = max(0, len(hashes) - width + 1)
    joined = np.zeros(many, "u8")
    for j in range(width):
        joined += hashes[j:j + many] * np.uint64(2 * j + 3)
        joined = mix(joined)
    text = np.repeat(np.arange(len(counts)), counts)[:many]
    first = np.flatnonzero(np.arange(many) + width <= np.cumsum(counts)[text])
    return joined[first], first, text[first]


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words, by text, and the number of them per text.

    A text of fewer words, but not none, has one window of all its words.
    """
    ends = np.cumsum(counts)
    n = np.where(counts >= width, counts - width + 1, 0)
    full = full_windows(hashes, counts, width)[0]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return full, n
    parts, at = [], 0
    stops = np.cumsum(n)
    for i in short:
        parts.append(full[at:stops[i]])
        at = stops[i]
        own = counts[i:i + 1].astype("u8")
        for h in hashes[ends[i] - counts[i]:ends[i]]:
            own = mix(own * np.uint64(31) ^ h)
        parts.append(own)
        n[i] = 1
    parts.append(full[at:])
    return np.concatenate(parts), n


def give_back() -> None:
    """Return freed memory to the machine: workers stay, and other stages need it."""
    pa.default_memory_pool().release_unused()
    trim = per_process("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim:
        trim(0)


def text_blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts; a slice is one text or up to BLOCK characters."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, held, size = 0, [], 0
    for i, item in enumerate(texts):
        text = item.as_py()
        length = len(text or "")
        if held and size + length > BLOCK:
            yield batch.slice(start, i - start), held
            start, held, size = i, [], 0
        held.append(text)
        size += length
    if held:
        yield batch.slice(start, len(held)), held
    give_back()


#: Places of a top-k that nothing has filled; null ids count as the largest.
NO_ID = np.iinfo("i8").max
LEAST = np.iinfo("i8").min


class Best:
    """The ``k`` best rows of each of ``n`` queries so far: highest score, then smallest id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((n, k), LEAST), np.full((n, k), NO_ID)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(who):
            return
        asked = np.unique(who)
        who = np.concatenate([np.repeat(asked, self.k), who])
        scores = np.concatenate([self.scores[asked].ravel(), scores])
        ids = np.concatenate([self.ids[asked].ravel(), ids])
        order = np.lexsort((ids, ~scores, who))  # ~x orders like -x and never overflows
        who, scores, ids = who[order], scores[order], ids[order]
        first = np.searchsorted(who, asked)
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.scores[asked], self.ids[asked] = scores[take].reshape(-1, self.k), ids[take].reshape(-1, self.k)

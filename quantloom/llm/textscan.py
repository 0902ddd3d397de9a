"""Vectorised scans of whole texts: an Arrow column's bytes are split into words, lines and byte n-grams by numpy.

Nothing here depends on Spark; the operators call it inside tasks, one Arrow batch at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned at a time; a text is never cut, so a longer one makes a portion of its own.
PORTION = 2 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and ends in them; a null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def portions(batch: pa.RecordBatch, column: str = "text", most: int = PORTION):
    """The batch in slices of about `most` bytes of text, so that memory does not depend on the batch size."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(a, b - a)


def release() -> None:
    """Gives freed memory back to the system: a worker stays between tasks, and its share of the executor's memory with it."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit keys over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int | None = None) -> np.ndarray:
    """A 64-bit hash of each segment [start, end) that holds a byte; with `most`, of its first bytes only."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts if most is None else np.minimum(ends - starts, most)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.multiply.accumulate(np.full(int(size.max()), MULTIPLIER, np.uint64))
    value = (data[np.repeat(starts, size) + at].astype(np.uint64) + np.uint64(1)) * powers[at]
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64))


def prefix_hashes(data: np.ndarray, offsets: np.ndarray, mosts: tuple[int | None, ...]) -> list[np.ndarray]:
    """`segment_hash` of the first `most` bytes of each segment, for each of `mosts`; segments follow one another, none is empty."""
    if len(offsets) < 2:
        return [np.zeros(0, np.uint64) for _ in mosts]
    starts, size = offsets[:-1], np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(size.max()), MULTIPLIER, np.uint64))
    summed = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(starts, size)], out=summed[1:])
    sizes = [size if most is None else np.minimum(size, most) for most in mosts]
    return [mixed(summed[starts + n] - summed[starts] + n.astype(np.uint64)) for n in sizes]


def segment_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each of the ascending, disjoint segments [start, end); segments of equal bytes have equal numbers, others never."""
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    own = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    segments = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(own)])
    return segments.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def owner(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that holds each of the ascending byte positions."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, owner(offsets, starts)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every \\n-split line that holds a word."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate((offsets[:-1], breaks + 1))
    starts = np.unique(starts[starts < len(data)])
    # a line that begins at a line feed is empty; a text's end is no end of the line that begins there, in the next text
    ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[np.searchsorted(offsets, starts, side="right")])
    seen = np.concatenate(([0], np.cumsum(~SPACE[data])))
    full = seen[ends] > seen[starts]
    return starts[full], ends[full], owner(offsets, starts[full])


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text the mask marks."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def windows(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n-word window that stays within a text, and the index of its first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    key = np.zeros(len(at), np.uint64)
    for k in range(n):
        key = mixed(key * np.uint64(MULTIPLIER) + hashes[at + k])
    return key, at


def repeated(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """True where a key stands at least twice in its text."""
    keys = mixed(keys ^ mixed(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def byte_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the order - 1 bytes before it, packed into one integer, and the byte's text.

    Runs of white space count as one blank and leading ones are left out; before a text stand order - 1 line feeds.
    """
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    kept = np.flatnonzero(inside | before)
    text = owner(offsets, kept)
    at = np.arange(len(kept)) + (order - 1) * (text + 1)
    stream = np.full(len(kept) + (order - 1) * len(offsets), 0x0A, np.uint8)
    stream[at] = np.where(inside[kept], data[kept], 0x20)
    grams = np.zeros(len(kept), np.uint64)
    for k in range(order - 1, -1, -1):
        grams = (grams << np.uint64(8)) | stream[at - k]
    return grams, text

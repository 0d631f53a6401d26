"""Word shingles of whole batches of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text bytes handled at once; a longer text is read in pieces of this size.
CHUNK_BYTES = 1 << 20
#: Bits of a shingle's hash; the bits above hold the text's number inside its chunk.
HASH_BITS = 48
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
#: Odd multipliers, the k-th power of one of them for place k.
BASE = 0x9E3779B97F4A7C15
PLACES = np.array([pow(BASE, k + 1, 1 << 64) for k in range(16)], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(CHUNK_BYTES + 65536, BASE, np.uint64))
_INVERSE = np.cumprod(np.full(CHUNK_BYTES + 65536, pow(BASE, -1, 1 << 64), np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _hash_words(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of at most a chunk of bytes (words that are longer still are hashed in one go)."""
    data = np.frombuffer(blob, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].view(np.int8)))
    first, end = edge[0::2], edge[1::2]
    powers, inverse = _POWERS, _INVERSE
    if len(data) > len(powers):
        powers = np.cumprod(np.full(len(data), BASE, np.uint64))
        inverse = np.cumprod(np.full(len(data), pow(BASE, -1, 1 << 64), np.uint64))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])
    before = np.where(first > 0, sums[first - 1], np.uint64(0)) if len(first) else np.zeros(0, np.uint64)
    return first, mix((sums[end - 1] - before) * inverse[first]) if len(first) else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words end."""
    if sum(map(len, texts)) + len(texts) <= CHUNK_BYTES:
        first, hashes = _hash_words(b"\n".join(texts))
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return hashes, np.searchsorted(first, bounds, "left")
    parts, ends, total = [], [], 0
    for text in texts:
        at = 0
        while at < len(text):
            stop = at + CHUNK_BYTES
            while stop < len(text) and not _SPACE[text[stop]]:
                stop += 1
            parts.append(_hash_words(text[at:stop])[1])
            total += len(parts[-1])
            at = stop
        ends.append(total)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(ends, int)


def shingle_counts(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of every distinct shingle of ``width`` words, sorted; a shorter text is one shingle."""
    words, ends = word_hashes(texts)
    starts = np.r_[0, ends[:-1]].astype(int)
    sizes = ends - starts
    keys = []
    if len(words) >= width:
        total = words[: len(words) - width + 1] * PLACES[0]
        for k in range(1, width):
            total = total + words[k : len(words) - width + 1 + k] * PLACES[k]
        owner = np.repeat(np.arange(len(texts)), sizes)
        whole = owner[: len(total)] == owner[width - 1 :]
        keys.append((owner[: len(total)][whole].astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(total[whole]) & HASH_MASK))
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = sizes[short] > k
            total[has] += words[starts[short[has]] + k] * PLACES[k]
        keys.append((short.astype(np.uint64) << np.uint64(HASH_BITS)) | (mix(total) & HASH_MASK))
    unique, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    return (unique >> np.uint64(HASH_BITS)).astype(int), unique & HASH_MASK, counts


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of consecutive texts of about a chunk of bytes, with the number of the first."""
    run: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and (size + len(data) > CHUNK_BYTES or len(run) >= 60_000):
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run

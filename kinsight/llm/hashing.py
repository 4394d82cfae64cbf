"""Hashes of words and of word windows, computed for whole batches of texts with numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93
#: Bytes hashed at a time; longer texts are cut at white space, which does not change their words.
SEGMENT = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer, so that all bits of a hash are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SEGMENT + 1
    up = np.full(n, _BASE, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _segment(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of at most SEGMENT bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if len(data) > SEGMENT:  # one word longer than a segment
        out = np.zeros(len(starts), dtype=np.uint64)
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            whole = np.uint64(0)
            for at in range(a, b, SEGMENT):
                whole = mixed(np.array([whole]) * np.uint64(_STEP) + _segment(raw[at : min(b, at + SEGMENT)])[1])[0]
            out[k] = whole
        return starts, out
    up, down = _powers()
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return starts, mixed((sums[ends] - sums[starts]) * down[starts])


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the hashes of its white-space separated words."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            starts, hashes = _segment(b"\n".join(group))
            bounds = np.cumsum([0] + [len(t) + 1 for t in group])
            out.extend(np.split(hashes, np.searchsorted(starts, bounds[1:-1])))
        group, size = [], 0

    for t in texts:
        if size + len(t) + 1 > SEGMENT:
            flush()
        if len(t) < SEGMENT:
            group.append(t)
            size += len(t) + 1
            continue
        parts, at = [], 0
        while at < len(t):
            end = min(len(t), at + SEGMENT)
            if end < len(t):
                cut = max(t.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut <= at:  # no white space here: take the whole word
                    cut = min((i for i in (t.find(c, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if i >= 0), default=len(t))
                end = cut
            parts.append(_segment(t[at:end])[1])
            at = max(end, at + 1)
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
    flush()
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words, in log2(size) steps."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    block, width, factor = h, 1, _STEP
    done, covered, rest = None, 0, size
    while True:
        if rest & 1:
            part = block[covered : covered + n]
            done = part if done is None else done * np.uint64(factor) + part
            covered += width
        rest >>= 1
        if not rest:
            return mixed(done)
        block = block[:-width] * np.uint64(factor) + block[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    if len(x) < size:
        return np.zeros(0, x.dtype)
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x

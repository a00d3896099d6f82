"""Names of token windows by doubling, and the anchors of windows.

A token has a 64-bit value in each of two lanes (of a byte, from a table of
random numbers; of a word, from a 128-bit hash of its bytes).  The name of a string is
made of the names of its halves by :func:`join`, which mixes all bits between
levels, so no structure of the texts carries through.  One lane selects
candidates; both lanes, 128 bits, decide equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

#: Tokens that are worked on at once; a longer text is cut into parts of so many.
SEGMENT = 1 << 17
_BYTE = np.random.default_rng(20_240_229).integers(1, 2**63, (2, 256), dtype=np.uint64)
_ODD = np.random.default_rng(77).integers(1, 2**63, (2, 3), dtype=np.uint64) | np.uint64(1)
_SPACES = b" \t\n\v\f\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def join(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """Names of strings from the names of a first and a last part."""
    first, last, scale = _ODD[lane]
    x = a * first
    x += b * last
    x ^= x >> np.uint64(31)
    x *= scale
    x ^= x >> np.uint64(32)
    return x


def ladder(values: np.ndarray, sizes: tuple[int, ...], lane: int = 0) -> list[np.ndarray]:
    """Names of all strings of each size (powers of two, ascending)."""
    out, x, size = [], values, 1
    for want in sizes:
        while size < want:
            x = join(x[:-size], x[size:], lane)
            size *= 2
        out.append(x)
    return out


def window_names(grams: np.ndarray, k: int, window: int, lane: int = 0) -> np.ndarray:
    """Names of all strings of ``window`` tokens from those of ``k``, which cover them."""
    n = max(0, len(grams) - (window - k))
    x = grams[:n]
    for at in [*range(k, window - k, k), window - k]:
        if at:
            x = join(x, grams[at : at + n], lane)
    return x


def word_parts(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts that end at white space."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[at:end]
        at = end


def word_edges(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the white-space words of some bytes begin and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[raw], [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def word_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 8 and the next 8 bytes of words as numbers (zeros after the end), and their lengths."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    n = ends - starts
    return eight[starts] & _MASKS[np.minimum(n, 8)], eight[starts + 8] & _MASKS[np.clip(n - 8, 0, 8)], n


def _lanes_of_part(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_edges(raw)
    low, high, n = word_keys(raw, starts, ends)
    size = n.astype(np.uint64)
    out = np.stack([join(join(low, high, lane), size, lane) for lane in (0, 1)])
    for i in np.flatnonzero(n > 16).tolist():
        digest = xxhash.xxh3_128_digest(data[starts[i] : ends[i]])
        out[:, i] = np.frombuffer(digest, "<u8")
    return out, starts


def word_lanes(texts: list[bytes]) -> list[np.ndarray]:
    """Both lanes of each text's words (rows lane 0, lane 1).

    A word of up to 16 bytes is its bytes and length, mixed; of a longer one, a 128-bit hash.
    """
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            lanes, starts = _lanes_of_part(b" ".join(group))
            edges = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])[:-1])
            out.extend(np.split(lanes, edges, axis=1))
        group, size = [], 0

    for data in texts:
        if len(data) > 1 << 20:
            flush()
            out.append(np.concatenate([_lanes_of_part(part)[0] for part in word_parts(data)], axis=1))
            continue
        group.append(data)
        size += len(data) + 1
        if size > 1 << 20:
            flush()
    flush()
    return out


def segments(texts: list[bytes], words: bool, window: int, lanes: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Token arrays with the texts they come from: values by lane, row, base, offsets.

    Part ``i`` is ``values[offsets[i]:offsets[i+1]]``, tokens of text ``row[i]``
    from ``base[i]`` on.  Short texts share an array; a long one is cut into
    parts that overlap by ``window - 1`` tokens, so each window is in exactly
    one.  Texts under ``window`` tokens are left out.
    """
    values, rows, bases, sizes, total = [], [], [], [], 0

    def flush():
        return [np.concatenate([v[j] for v in values]) for j in range(lanes)], np.array(rows), np.array(bases), np.concatenate([[0], np.cumsum(sizes)])

    known = word_lanes(texts) if words else None
    for row, data in enumerate(texts):
        own = None if known is None else known[row]
        n = len(data) if own is None else own.shape[1]
        for base in range(0, n - window + 1, SEGMENT):
            end = min(base + SEGMENT + window - 1, n)
            part = _BYTE[:lanes, np.frombuffer(data, np.uint8, end - base, base)] if own is None else own[:lanes, base:end]
            if total and total + (end - base) > SEGMENT:
                yield flush()
                values, rows, bases, sizes, total = [], [], [], [], 0
            values.append(part)
            rows.append(row)
            bases.append(base)
            sizes.append(end - base)
            total += end - base
    if values:
        yield flush()


def _sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` keys, from block prefixes and suffixes."""
    n = len(keys) - w + 1
    blocks = -(-len(keys) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(grams: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows within parts: part, place, first and last window.

    A window's anchor is the first of its smallest ``k``-token names, so equal
    windows have equal anchors at equal places.  Windows ``first..last`` (places
    in the array) are those that chose the anchor; windows over a part's end do
    not count.
    """
    bits = len(grams).bit_length()
    keys = ((grams >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    least = _sliding_min(keys, window - k + 1)
    chosen = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    new[offsets[(offsets > 0) & (offsets < len(chosen))]] = True
    # A run of windows ends before the next run or at the part's last valid window.
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(chosen)) - 1
    part = np.searchsorted(offsets, first, "right") - 1
    ok = first + window <= offsets[part + 1]
    first, last, part = first[ok], last[ok], part[ok]
    return part, chosen[first], first, np.minimum(last, offsets[part + 1] - window)

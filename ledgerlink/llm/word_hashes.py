"""64-bit hashes of the words of many texts at once, and of runs of words at any place.

Words of up to 8 bytes have a hash that no other word of their length has. Longer ones go through two chains of 64 bits,
8 bytes at a time, each step mixed before the next, and very long ones through xxh3. All words of a block are
hashed together, so that no short word becomes a Python object. Runs of words are hashed by halves: the hashes of
two halves are mixed again. Nothing here is linear, so that words or texts built of repeated parts differ like any
others. Kinds 0 and 1 have different constants.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Texts are joined to blocks of about so many bytes; longer ones are cut at white space.
BLOCK = 1 << 17
#: Odd constants of each kind, and what is added to a word before it is mixed.
FACTORS = tuple(tuple(map(np.uint64, x)) for x in ((0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB), (0xC2B2AE3D27D4EB4F, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)))
SALTS = tuple(tuple(map(np.uint64, x)) for x in ((0x243F6A8885A308D3, 0x13198A2E03707344), (0xA4093822299F31D0, 0x082EFA98EC4E6C89)))
#: Signs of a word from which xxh3 takes it whole.
LONG = 64
BLANK = np.zeros(256, bool)
BLANK[list(b"\t\n\v\f\r ")] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of h, in place."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def hashed_runs(signs: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: int = 0, odd: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the runs begin:end of signs (bytes, or pairs of bytes); runs that are odd are left to the caller."""
    width, size = signs.itemsize, end - begin
    per = 8 // width
    padded = np.concatenate((signs, np.zeros(per, signs.dtype)))
    eight = np.ndarray((len(signs) + 1,), "<u8", padded, 0, (width,))
    front = np.array([(1 << 8 * width * k) - 1 for k in range(per + 1)], np.uint64)
    (f, g, last), (s, t) = FACTORS[kind], SALTS[kind]
    token = eight[begin] & front[np.minimum(size, per)]
    h = mixed(mixed((token ^ s) * f) + size.astype(np.uint64) * last)
    rows = np.flatnonzero(size > per if odd is None else (size > per) & ~odd)
    if len(rows):
        for k in rows[size[rows] > LONG].tolist():
            h[k] = xxhash.xxh3_64_intdigest(signs[begin[k] : end[k]].tobytes(), kind)
        rows = rows[size[rows] <= LONG]
        x, y, done = h[rows], mixed((token[rows] + t) * g), per
        while len(rows):
            token = eight[begin[rows] + done] & front[np.minimum(size[rows] - done, per)]
            x, y, done = mixed((x ^ token) * f), mixed((y + token) * g), done + per
            whole = size[rows] <= done
            h[rows[whole]] = mixed(x[whole] ^ (y[whole] * last))
            rows, x, y = rows[~whole], x[~whole], y[~whole]
    return h


def _hashed(data: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a block, where they begin, and where they end."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~BLANK[data]
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    return hashed_runs(data, begin, end, kind), begin, end


def _pieces(text: bytes):
    """A long text, cut at white space."""
    data, at = np.frombuffer(text, np.uint8), 0
    while at < len(data):
        size = BLOCK
        while at + size < len(data) and not (blanks := np.flatnonzero(BLANK[data[at : at + size]])).size:
            size *= 2  # a word longer than the block
        end = len(data) if at + size >= len(data) else at + int(blanks[-1]) + 1
        yield data[at:end]
        at = end


def word_blocks(texts: list[bytes], kind: int = 0):
    """(first, data, h, begin, end, cuts): data holds the texts from first on, as many as there are cuts, and cuts are
    the numbers of words before the end of each. A long text comes alone, in as many pieces as it needs; empty ones too."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) <= BLOCK:
            size += len(texts[to]) + 1
            to += 1
        if to == at:
            for data in _pieces(texts[at]):
                h, begin, end = _hashed(data, kind)
                yield at, data.tobytes(), h, begin, end, [len(h)]
            at += 1
            continue
        data = b" ".join(texts[at:to])
        h, begin, end = _hashed(np.frombuffer(data, np.uint8), kind)
        yield at, data, h, begin, end, np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts[at:to]])).tolist()
        at = to


def word_hashes(texts: list[bytes], kind: int = 0) -> list[np.ndarray]:
    """Per text the hashes of its words, which [\\x20\\x09-\\x0D] part."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for first, _, h, _, _, cuts in word_blocks(texts, kind):
        for i, (a, z) in enumerate(zip([0, *cuts[:-1]], cuts, strict=True), first):
            parts[i].append(h[a:z])
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in parts]


class Rolling:
    """Hashes of runs of words at any place, made of the hashes of their halves."""

    def __init__(self, h: np.ndarray, kind: int = 0):
        self.kind, self.whole = kind, {1: h}

    def _joined(self, size: int) -> np.ndarray:
        """Of every run of size words; longer runs take the halves of shorter ones again."""
        if size not in self.whole:
            front = 1 << (size - 1).bit_length() - 1  # the greatest power of two below size
            a, b = self._joined(front), self._joined(size - front)
            f, g, last = FACTORS[self.kind]
            n = len(self.whole[1]) - size + 1
            self.whole[size] = mixed(mixed(a[:n] * f + g) ^ (b[front : front + n] * last))
        return self.whole[size]

    def at(self, size: int, places: np.ndarray | None = None) -> np.ndarray:
        h = self._joined(size)
        return h.copy() if places is None else h[places]


def places(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, count many."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)

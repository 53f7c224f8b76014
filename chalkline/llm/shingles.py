"""Word shingles of whole texts as 64-bit hashes, for a batch of texts at a time."""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WIDTH = 5
BASE = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2^64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                whole = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                self.up, self.down = whole(BASE), whole(np.uint64(pow(int(BASE), -1, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of (data[k] + 1) BASE^k over i <= k < j, modulo 2^64."""
    up, _ = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = POWERS.upto(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * down[starts])


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """stretch_hashes() of data[i : i + width] for every i."""
    _, down = POWERS.upto(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[width:] - sums[:-width]) * down[: max(0, len(sums) - width)])


#: A prime modulus beside 2^64, which has strings that collide whatever the base.
PRIME, ROOT = (1 << 31) - 1, 48271


class PrimePowers:
    """Powers of ROOT and of its inverse modulo PRIME, as far as they were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            for name, base in (("up", ROOT), ("down", pow(ROOT, -1, PRIME))):
                known = getattr(self, name)
                step = np.uint64(pow(base, len(known), PRIME))
                setattr(self, name, np.concatenate([known, known * step % np.uint64(PRIME)]))
        return self.up[:n], self.down[:n]


PRIME_POWERS = PrimePowers()


def content_hashes(data: np.ndarray, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] made of two sums, one modulo 2^64 and one modulo PRIME; data has under 2^24 bytes."""
    up, down = PRIME_POWERS.upto(len(data) + 1)
    own = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=own[1:])  # under 2^24 * 2^8 * 2^31
    other = (own[ends] - own[starts]) % np.uint64(PRIME) * down[starts] % np.uint64(PRIME)
    return mixed(stretch_hashes(sums, starts, ends) ^ mixed(other + np.uint64(1)))


class Words:
    """Word hashes of texts that stand one after another in ``data``; offsets has a text more."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        before[inner] = True
        after[inner - 1] = True
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        self.hashes = stretch_hashes(prefix_sums(data), starts, ends)
        #: Place of each text's first word; one place more than texts.
        self.firsts = np.searchsorted(starts, offsets)

    def sequence_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit keys of each text's sequence of words."""
        counts = np.diff(self.firsts)
        place = np.arange(len(self.hashes)) - np.repeat(self.firsts[:-1], counts)
        up, _ = POWERS.upto(int(counts.max(initial=0)) + 1)
        keys = []
        with np.errstate(over="ignore"):
            for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDEF01)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.hashes + salt) * up[place])])
                keys.append(mixed(sums[self.firsts[1:]] - sums[self.firsts[:-1]] + counts.astype(np.uint64) * salt))
        return keys[0], keys[1]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, place of each text's first shingle): WIDTH words each; a shorter text with words is one shingle."""
        n, counts = len(self.hashes), np.diff(self.firsts)
        own = np.maximum(counts - WIDTH + 1, (counts > 0).astype(counts.dtype))
        firsts = np.concatenate([[0], np.cumsum(own)])
        start = np.arange(firsts[-1]) - np.repeat(firsts[:-1], own) + np.repeat(self.firsts[:-1], own)
        last = np.repeat(self.firsts[1:], own)
        out = np.zeros(len(start), np.uint64)
        padded = np.concatenate([self.hashes, np.zeros(WIDTH, np.uint64)])
        with np.errstate(over="ignore"):
            for j in range(WIDTH):
                word = padded[np.minimum(start + j, n)]
                out = out * BASE + np.where(start + j < last, word, np.uint64(j + 1))
        return mixed(out), firsts


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a pyarrow string array without copying; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.empty(0, np.uint8)
    return raw, offsets - low


def shingle_set(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)])).shingles()[0])

"""External induced suffix sorting with common prefixes.

A shard is a sequence of stretches of bytes. Suffixes are typed S or L by
their successor. The leftmost S suffixes of runs (S*) are named by their
substrings and sorted by recursion on the string of names, until all names
differ. Then two sweeps induce the rest: L suffixes from smaller to larger
ones, S suffixes back. What is induced has a known slot, the next one of its
first symbol, so a sweep is driven by a priority queue by slot: tuples of
(slot, suffix, common prefix) wait in pages of slots, in memory up to a budget
and in files beyond it, and a page is loaded when the sweep comes to it. A
sweep advances by runs of slots that are filled already; whatever they induce
falls behind them, so a run is handled as a whole.

Common prefixes travel with the tuples: two suffixes induced one after the
other under the same symbol share one symbol more than all that stands between
what induced them. Only S* neighbours, and an L and an S suffix that meet under
one symbol, are compared in the text. Prefixes count up to a limit.

The text and the types are mapped files once a shard is over the budget; they
are read at the predecessors of each run. Naming holds a few words for each S*.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

#: Symbols: the end of the shard, the end of a stretch, then bytes.
END, CUT, FIRST = 0, 1, 2
SIGMA = FIRST + 256
#: Bytes of queues, and of each array, that a sorter holds in memory before it goes to disk.
BUDGET = 12 << 20
#: Slots in a page of a queue, as a power of two.
PAGE_BITS = 18
#: Symbols that are looked at together where a whole string is read.
BLOCK = 1 << 20


class Store:
    """Arrays in memory or, over the budget, in files of a folder that close() removes."""

    def __init__(self, budget: int = BUDGET):
        self.budget, self.folder, self.files = budget, None, 0

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def array(self, n: int, kind: type) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.budget or not n:
            return np.empty(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,)).view(np.ndarray)

    def close(self) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


TUPLE = np.dtype([("slot", np.int64), ("suffix", np.int64), ("shared", np.uint16)])


class SlotQueue:
    """A monotone priority queue by slot: pages() gives pages of slots in order, push() fills slots of the page at hand or of later ones."""

    def __init__(self, store: Store, slots: int, bits: int = PAGE_BITS):
        self.store, self.slots, self.bits = store, slots, bits
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]] = {}
        self.files: dict[int, str] = {}
        self.held, self.first, self.end = 0, 0, 0
        self.suffixes, self.shared = np.empty(0, np.int64), np.empty(0, np.uint16)

    def push(self, slots: np.ndarray, suffixes: np.ndarray, shared: np.ndarray | None) -> None:
        """Tuples whose slots ascend."""
        if not len(slots):
            return
        now = 0
        if slots[0] < self.end:
            now = len(slots) if slots[-1] < self.end else int(np.searchsorted(slots, self.end))
            own = slots[:now] - self.first
            self.suffixes[own] = suffixes[:now]
            if shared is not None:
                self.shared[own] = shared[:now]
        while now < len(slots):
            page = int(slots[now]) >> self.bits
            after = len(slots) if slots[-1] >> self.bits == page else int(np.searchsorted(slots, (page + 1) << self.bits))
            self.waiting.setdefault(page, []).append((slots[now:after], suffixes[now:after], None if shared is None else shared[now:after]))
            self.held += (after - now) * TUPLE.itemsize
            now = after
        if self.held > self.store.budget:
            self._spill()

    def _spill(self) -> None:
        for page, parts in self.waiting.items():
            path = self.files.get(page) or self.store.path()
            self.files[page] = path
            with open(path, "ab") as f:
                for slots, suffixes, shared in parts:
                    tuples = np.zeros(len(slots), TUPLE)
                    tuples["slot"], tuples["suffix"] = slots, suffixes
                    if shared is not None:
                        tuples["shared"] = shared
                    f.write(tuples.tobytes())
        self.waiting, self.held = {}, 0

    def pages(self) -> Iterator[tuple[int, int]]:
        """(first slot, number of slots) of each page, whose arrays are ``suffixes``, -1 where nothing is yet, and ``shared``."""
        for page in range(-(-self.slots >> self.bits)):
            self.first = page << self.bits
            size = min(1 << self.bits, self.slots - self.first)
            self.end = self.first + size
            self.suffixes, self.shared = np.full(size, -1, np.int64), np.zeros(size, np.uint16)
            if path := self.files.pop(page, None):
                tuples = np.fromfile(path, TUPLE)
                os.remove(path)
                own = tuples["slot"] - self.first
                self.suffixes[own], self.shared[own] = tuples["suffix"], tuples["shared"]
            for slots, suffixes, shared in self.waiting.pop(page, []):
                own = slots - self.first
                self.suffixes[own] = suffixes
                if shared is not None:
                    self.shared[own] = shared
                self.held -= len(slots) * TUPLE.itemsize
            yield self.first, size


def smaller_than_next(text: np.ndarray, store: Store) -> np.ndarray:
    """True for suffixes of type S: smaller than the next one. The last one is S."""
    n = len(text)
    small = store.array(n, bool)
    carry = True
    for low in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        part = np.asarray(text[low : low + BLOCK + 1]).astype(np.int64)
        step = np.sign(np.diff(part))
        if low + len(part) == n:
            step = np.append(step, 1)[: n - low]
        index = np.arange(len(step))
        following = np.minimum.accumulate(np.where(step != 0, index, len(step))[::-1])[::-1]
        up = np.where(following < len(step), np.append(step, 0)[following] > 0, carry)
        small[low : low + len(up)] = up
        carry = bool(up[0])
    return small


def substring_names(text: np.ndarray, stars: np.ndarray, sigma: int) -> np.ndarray:
    """Names of the substrings from each S* to the next, both ends included, in their order.

    A substring is compared word by word, a word being as many symbols as fit;
    past its end stands a symbol above all others, for an S suffix that has
    more before it is the greater one. Only what is still tied is looked at
    again.
    """
    last = np.append(stars[1:], len(text) - 1)
    length = last - stars + 1
    bits = max(1, int(sigma).bit_length())
    pack = 63 // bits
    names = np.zeros(len(stars), np.int64)
    open_, word = np.arange(len(stars)), 0
    while len(open_):
        key = np.zeros(len(open_), np.uint64)
        for j in range(word * pack, word * pack + pack):
            at = np.minimum(stars[open_] + j, len(text) - 1)
            symbol = np.where(j < length[open_], text[at].astype(np.uint64), np.uint64((1 << bits) - 1))
            key = (key << np.uint64(bits)) | symbol
        order = np.lexsort((key, names[open_])) if word else np.argsort(key, kind="stable")
        a, b = names[open_][order], key[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        # Names are places of first members, so that parts refined later stay inside their old name.
        group = np.ones(len(order), bool)
        group[1:] = a[1:] != a[:-1]
        index = np.arange(len(order))
        inside = index - np.maximum.accumulate(np.where(group, index, 0))
        first = np.maximum.accumulate(np.where(fresh, index, 0))
        names[open_[order]] = a + inside[first]
        counts = np.diff(np.append(np.flatnonzero(fresh), len(order)))
        tied = np.repeat(counts > 1, counts)
        word += 1
        left = open_[order][tied]
        open_ = np.sort(left[length[left] >= word * pack])  # one that ends with the word still has its end to be told from a longer one
    return names


def four_at_once(text: np.ndarray, store: Store) -> np.ndarray | None:
    """The four symbols from each place on as one number, the first one lowest; None if that is far over the budget."""
    if len(text) * 8 > 4 * store.budget or text.dtype != np.uint16:
        return None
    padded = np.append(text, np.zeros(3, text.dtype)).astype(np.uint64)
    n = len(text)
    return padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, fours: np.ndarray | None = None) -> np.ndarray:
    """Symbols that the different suffixes a and b have in common, up to ``limit``; the last symbol of the text is single, so none runs past it."""
    out = np.full(len(a), limit, np.uint16)
    source, step = (text, 1) if fours is None else (fours, 4)
    x, y, open_ = a, b, np.arange(len(a))
    for done in range(0, limit, step):
        p, q = source.take(x, mode="clip"), source.take(y, mode="clip")
        same = p == q
        if not same.all():
            apart, more = np.flatnonzero(~same), 0
            if step > 1:
                differ = p[apart] ^ q[apart]
                low = (differ & (~differ + np.uint64(1))).astype(np.float64)  # the lowest bit that differs
                more = (np.frexp(low)[1] - 1) // 16
            out[open_[apart]] = np.minimum(done + more, limit)
            x, y, open_ = x[same], y[same], open_[same]
        if not len(open_):
            break
        x, y = x + step, y + step
    return out


def _counts(symbols: np.ndarray, sigma: int, of: np.ndarray | None = None) -> np.ndarray:
    """How often each symbol stands, at all places or where ``of`` is true."""
    out = np.zeros(sigma, np.int64)
    for low in range(0, len(symbols), BLOCK):
        part = np.asarray(symbols[low : low + BLOCK])
        out += np.bincount(part if of is None else part[of[low : low + BLOCK]], minlength=sigma)
    return out


class _Minima:
    """Least value of any stretch of an array: minima of stretches whose lengths are powers of two."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 << (len(self.levels) - 1) <= len(x):
            half, before = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(before[:-half], before[half:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over low..high, both included, none of them empty."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - (1 << int(k)) + 1])
        return out


NONE = np.iinfo(np.uint16).max


def _sweep(
    queue: SlotQueue,
    text: np.ndarray,
    small: np.ndarray,
    mirrored: bool,
    begin: np.ndarray,
    meets: np.ndarray,
    limit: int | None,
    fours: np.ndarray | None,
    visit: Callable[[int, np.ndarray, np.ndarray | None], None],
) -> None:
    """Runs of filled slots in order; each suffix of a run induces the one before it, if that is of the wanted type, into the next slot of its symbol.

    Forward L suffixes are wanted, mirrored S suffixes. ``begin`` has the first
    slot of each symbol, ``meets`` the slots where a symbol's second type
    begins after its first. ``visit`` gets each page: the number of slots
    before it, its suffixes, and the prefix that each shares with the one
    before it in this order.
    """
    sigma, head, opens = len(begin), begin.copy(), np.unique(begin)
    since = np.full(sigma, NONE, np.uint16) if limit is not None else None  # least prefix since the last push of each symbol
    last, came, meet = 0, 0, 0  # the suffix before the run, what came with it, and the next slot where types meet
    for first, size in queue.pages():
        told = np.zeros(size, np.uint16) if limit is not None else None
        at, window = 0, 1024
        while at < size:
            seen = queue.suffixes[at : at + window]
            empty = seen < 0
            stop = int(empty.argmax())
            end = at + (stop if empty[stop] else len(seen))
            if end == at:
                raise AssertionError("a slot that its sweep has come to is empty")
            own = queue.suffixes[at:end]
            if limit is not None:
                shared = queue.shared[at:end]
                if mirrored:
                    # An L suffix came with what it shares with the smaller one, which this order wants one slot later.
                    later = shared[-1]
                    shared = np.where(small[own], shared, np.append(np.uint16(came), shared[:-1]))
                    came = int(later)
                while meet < len(meets) and meets[meet] < first + end:
                    k = int(meets[meet]) - first - at
                    before = own[k - 1] if k else last
                    shared[k] = shared_prefix(text, np.array([before]), own[k : k + 1], limit, fours)[0]
                    meet += 1
                if mirrored:  # a symbol that has L suffixes only opens with one
                    low, high = np.searchsorted(opens, (first + at, first + end))
                    shared[opens[low:high] - first - at] = 0
                told[at:end] = shared
            last = int(own[-1])
            place = np.flatnonzero(own > 0)
            before = own[place] - 1
            wanted = small[before] if mirrored else ~small[before]
            before, place = before[wanted], place[wanted]
            if len(before):
                symbols = text[before]
                order = np.argsort(symbols.dtype.type(sigma) - symbols if mirrored else symbols, kind="stable")  # so that slots ascend
                before, place, symbols = before[order], place[order], symbols[order]
                fresh = np.ones(len(symbols), bool)
                np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
                starts = np.flatnonzero(fresh)
                counts = np.diff(np.append(starts, len(symbols)))
                opening = symbols[starts]
                slots = np.repeat(head[opening] - starts, counts) + np.arange(len(symbols))
                carried = None
                if limit is not None:
                    carried = np.empty(len(symbols), np.uint16)
                    if len(starts) < len(symbols):
                        follow = np.flatnonzero(~fresh)
                        carried[follow] = _Minima(shared).of(place[follow - 1] + 1, place[follow])
                    carried[starts] = np.minimum(since[opening], np.minimum.accumulate(shared)[place[starts]])
                    np.minimum(carried, limit - 1, out=carried)
                    carried += 1
                    carried[starts[head[opening] == begin[opening]]] = 0  # nothing stands before the first of a symbol
                    after = np.append(np.minimum.accumulate(shared[::-1])[::-1], np.uint16(NONE))
                    np.minimum(since, after[0], out=since)
                    since[opening] = after[place[starts + counts - 1] + 1]
                head[opening] += counts
                queue.push(slots, before, carried)
            elif limit is not None:
                np.minimum(since, shared.min(), out=since)
            window = min(max(1024, 4 * (end - at)), 1 << queue.bits)
            at = end
        visit(first, queue.suffixes, told)


def induced(
    text: np.ndarray,
    small: np.ndarray,
    stars: tuple[np.ndarray, np.ndarray | None],
    sigma: int,
    store: Store,
    limit: int | None,
    visit: Callable[[int, np.ndarray, np.ndarray | None], None],
    bits: int = PAGE_BITS,
) -> None:
    """All suffixes from the S* suffixes in order and what neighbours of those share, given to ``visit`` from the greatest to the smallest.

    A call has (how many came before, suffixes, the prefix that each shares
    with the one before it, the greater one); prefixes only if ``limit`` is given.
    """
    n = len(text)
    own, star_shared = stars
    every, smalls, starred = _counts(text, sigma), _counts(text, sigma, small), _counts(text[own], sigma)
    larges = every - smalls
    fours = four_at_once(text, store) if limit is not None else None
    up = lambda sizes: np.cumsum(sizes) - sizes
    # Forward: under each symbol its L suffixes, then its S* suffixes. Mirrored: its S suffixes, then its L suffixes.
    begin, full, star_begin = up(larges + starred), up(every), up(starred)
    mirrored = n - full - every
    forward, backward = SlotQueue(store, int((larges + starred).sum()), bits), SlotQueue(store, n, bits)
    for low in range(0, len(own), BLOCK):
        part = own[low : low + BLOCK]
        symbols = text[part].astype(np.int64)
        shared = None if limit is None else star_shared[low : low + BLOCK]
        forward.push((begin + larges - star_begin)[symbols] + np.arange(low, low + len(part)), part, shared)
    backward.push(np.array([n - 1]), np.array([n - 1]), np.zeros(1, np.uint16))  # the end itself

    def hand_over(first: int, page: np.ndarray, shared: np.ndarray | None) -> None:
        large = np.flatnonzero(~small[page])[::-1]
        suffixes = page[large]
        slots = n - 1 - ((full - begin)[text[suffixes]] + first + large)
        backward.push(slots, suffixes, None if shared is None else shared[large])

    both = (larges > 0) & (starred > 0)
    _sweep(forward, text, small, False, begin, (begin + larges)[both], limit, fours, hand_over)
    both = (larges > 0) & (smalls > 0)
    _sweep(backward, text, small, True, mirrored, np.sort((mirrored + smalls)[both]), limit, fours, visit)


def sorted_stars(text: np.ndarray, small: np.ndarray, sigma: int, store: Store, bits: int = PAGE_BITS, limit: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The S* suffixes in order, by recursion on the string of their names, and what each shares with the one before it, if a limit is given."""
    edges = [(max(1, low), min(low + BLOCK, len(small))) for low in range(0, len(small), BLOCK)]
    stars = np.concatenate([np.flatnonzero(small[a:b] & ~small[a - 1 : b - 1]) + a for a, b in edges])
    names = substring_names(text, stars, sigma)
    used = np.zeros(len(stars), bool)
    used[names] = True
    dense = (np.cumsum(used) - 1)[names]
    kinds = int(dense.max()) + 1
    if kinds == len(stars):
        order = np.argsort(dense, kind="stable")
    else:
        kind = np.uint16 if kinds < NONE else np.int64  # 16 bits are sorted by counting
        order = suffix_order(dense.astype(kind), kinds, store, bits)
    stars = stars[order]
    if limit is None:
        return stars, None
    fours, shared = four_at_once(text, store), np.zeros(len(stars), np.uint16)
    for low in range(1, len(stars), BLOCK):
        own = stars[low : low + BLOCK]
        shared[low : low + BLOCK] = shared_prefix(text, stars[low - 1 : low - 1 + len(own)], own, limit, fours)
    return stars, shared


def suffix_order(text: np.ndarray, sigma: int, store: Store, bits: int = PAGE_BITS) -> np.ndarray:
    """Suffixes of ``text``, whose last symbol is its only smallest one, in order."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = smaller_than_next(text, store)
    out = store.array(n, np.int64)

    def place(first: int, page: np.ndarray, _: np.ndarray | None) -> None:
        out[n - first - len(page) : n - first] = page[::-1]

    induced(text, small, sorted_stars(text, small, sigma, store, bits), sigma, store, None, place, bits)
    return out


def repeated_starts(stretches: list[bytes], length: int, budget: int = BUDGET, bits: int = PAGE_BITS) -> np.ndarray:
    """Places, in the concatenation of the stretches, at which a string of ``length`` bytes starts that also starts elsewhere in them."""
    store = Store(budget)
    try:
        sizes = np.array([len(x) for x in stretches], np.int64)
        n = int(sizes.sum()) + len(stretches) + 1
        text = store.array(n, np.uint16)
        room = store.array(n, np.uint16)  # bytes to the end of the stretch, up to length
        ends = np.cumsum(sizes + 1) - 1
        for x, end in zip(stretches, ends.tolist(), strict=True):
            text[end - len(x) : end] = np.frombuffer(x, np.uint8).astype(np.uint16) + FIRST
            room[end - len(x) : end] = np.minimum(np.arange(len(x), 0, -1), length)
            text[end], room[end] = CUT, 0
        text[n - 1], room[n - 1] = END, 0
        found = store.array(n, bool)
        found[:] = False
        last = [n - 1]

        def mark(_: int, own: np.ndarray, shared: np.ndarray) -> None:
            before = np.append(last[0], own[:-1])
            last[0] = int(own[-1])
            same = (shared >= length) & (room[own] >= length) & (room[before] >= length)
            found[own[same]] = found[before[same]] = True

        if n > 1:
            small = smaller_than_next(text, store)
            induced(text, small, sorted_stars(text, small, SIGMA, store, bits, length), SIGMA, store, length, mark, bits)
        keep = np.ones(n, bool)
        keep[ends], keep[n - 1] = False, False
        return np.asarray(found)[keep]
    finally:
        store.close()

"""NumPy kernels over batches of sequences: end-free edit distances of all windows at once, and what follows from them.

A distance is that of the banded recursion on one-byte letters, a column of all windows at a time, so a batch costs some hundred vector operations
whatever its number of windows. Windows are cut in chunks, which bounds memory whatever the length of the reads."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

CHUNK = 1 << 15
LETTER = np.full(256, -1, np.int8)
LETTER[[ord(c) for c in "ACGT"]] = range(4)
OTHER = np.zeros(256, np.uint8)
OTHER[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]


def letters(text: str | bytes) -> np.ndarray:
    return np.frombuffer(text.encode("latin-1", "replace") if isinstance(text, str) else text, np.uint8)


def tail_free(words: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Edit distance of each row of words and the query (one for all, or a row for each), with k letters free at the end of either; k + 1 stands for
    all that is farther, and 0 for all if k isn't less than both lengths."""
    size, n, m = len(words), words.shape[1], query.shape[-1]
    if k >= n or k >= m:
        return np.zeros(size, np.int8)
    a = np.ascontiguousarray(words.T)
    if query.ndim == 1:
        differ = {c: (a != c).view(np.int8) for c in set(query.tolist())}
        unequal = lambda i, j: differ[int(query[j])][i]
    else:
        b = np.ascontiguousarray(query.T)
        unequal = lambda i, j: (a[i] != b[j]).view(np.int8)
    far = np.full(size, k + 1, np.int8)
    above = [np.full(size, min(j, k + 1), np.int8) for j in range(m + 1)]
    best = far.copy()
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= k:
            row[0] = np.full(size, i, np.int8)
        for j in range(max(1, i - k), min(m, i + k) + 1):
            cell = above[j - 1] + unequal(i - 1, j - 1)
            np.minimum(cell, above[j] + np.int8(1), out=cell)
            row[j] = np.minimum(cell, row[j - 1] + np.int8(1), out=cell)
        if i >= n - k:
            np.minimum(best, row[m], out=best)
        above = row
    for j in range(m - k, m + 1):
        np.minimum(best, above[j], out=best)
    return np.minimum(best, far)


def counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many rows: each row's group, and its number within it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class Reads:
    """Sequences joined in one buffer."""

    def __init__(self, seqs: Sequence[str | None]):
        raw = [(s or "").encode("latin-1", "replace") for s in seqs]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.buffer = np.frombuffer(b"".join(raw), np.uint8)

    def windows(self, at: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
        """The windows of n letters that begin at these places of the buffer, chunk by chunk."""
        if len(at):
            view = np.lib.stride_tricks.sliding_window_view(self.buffer, n)
            for i in range(0, len(at), CHUNK):
                part = slice(i, min(len(at), i + CHUNK))
                yield part, view[at[part]]


def places(seqs: Sequence[str | None], query: str, k: int, first_exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """1-based place and distance of each sequence's window that is closest to query within k edits, the last of equal ones, or with first_exact the
    first exact one; place 0 where there is none."""
    reads, word = Reads(seqs), letters(query)
    counts = np.maximum(reads.size - len(word) + 1, 0)
    owner, place = counted(counts)
    dist = np.empty(len(owner), np.int64)
    for part, words in reads.windows(reads.first[owner] + place, len(word)):
        dist[part] = tail_free(words, word, k)
    pos, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        big = int(counts.max()) + 1
        rank = dist * big + np.where(first_exact & (dist == 0), place, big - 1 - place)
        key = np.minimum.reduceat(rank, (np.cumsum(counts) - counts)[some])
        found, left = key // big, key % big
        at = np.where(first_exact & (found == 0), left, big - 1 - left)
        near = found <= k
        pos[some[near]], best[some[near]] = at[near] + 1, found[near]
    return pos, best


def near_windows(seqs: Sequence[str | None], regions: tuple[Sequence, Sequence] | None, word: str, back: str, k: int) -> tuple[np.ndarray, ...]:
    """Owner, region (numbered through), place, strand (3 where back is closer than word) and distance of all windows within k edits, in order.

    regions: starts and ends of the places to look at, by sequence; the whole sequence if None."""
    reads, n = Reads(seqs), len(word)
    if regions is None:
        owner = np.arange(len(reads.size))
        start, end = np.ones(len(owner), np.int64), reads.size
    else:
        many = np.array([0 if s is None else len(s) for s in regions[0]], np.int64)
        owner = np.repeat(np.arange(len(many)), many)
        flat = lambda xs: np.concatenate([np.asarray(x, np.int64) for x in xs if x is not None and len(x)] or [np.zeros(0, np.int64)])
        start, end = np.maximum(flat(regions[0]), 1), np.minimum(flat(regions[1]), reads.size[owner])
    region, step = counted(np.maximum(end - start + 2 - n, 0))
    place, owner = start[region] + step, owner[region]
    at = reads.first[owner] + place - 1
    kept: list[tuple] = []
    for part, words in reads.windows(at, n):
        ahead, behind = tail_free(words, letters(word), k), tail_free(words, letters(back), k)
        dist = np.minimum(ahead, behind)
        near = np.flatnonzero(dist <= k)
        kept.append((owner[part][near], region[part][near], place[part][near], np.where(behind[near] < ahead[near], 3, 0), dist[near].astype(np.int64)))
    if not kept:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate([x[i] for x in kept]) for i in range(5))


def grouped(owner: np.ndarray, size: int, *values: np.ndarray) -> list[list[np.ndarray]]:
    """Each value's rows by owner, as lists of arrays."""
    cuts = np.searchsorted(owner, np.arange(1, size))
    return [np.split(v.astype(np.int32), cuts) if size else [] for v in values]


def scanned(seqs: Sequence[str | None], regions: tuple[Sequence, Sequence] | None, word: str, back: str, k: int) -> list[list[np.ndarray]]:
    """Places, strands and distances of the adapter's hits by sequence.

    Within a region, windows count from left to right while they are as close as the closest so far; one that begins less than the adapter's length
    behind the hit before takes its place. So a window that counts is a hit unless the next that counts is that near."""
    owner, region, place, strand, dist = near_windows(seqs, regions, word, back, k)
    step = k + 2
    closest = np.minimum.accumulate(dist - region * step) + region * step if len(dist) else dist
    counts = dist <= closest
    owner, place, strand, dist = (x[counts] for x in (owner, place, strand, dist))
    last = np.ones(len(owner), bool)
    if len(owner) > 1:
        last[:-1] = (owner[1:] != owner[:-1]) | (place[1:] - place[:-1] >= len(word))
    return grouped(owner[last], len(seqs), place[last], strand[last], dist[last])


def jumped(seqs: Sequence[str | None], word: str, back: str, k: int) -> list[list[np.ndarray]]:
    """Places and strands (1 and -1) of windows within k edits of word, else of back, from left to right, going on behind each.

    A window that is near to both counts for word, whichever is closer."""
    n, near = len(word), []
    for way, text in ((1, word), (-1, back)):
        o, _, p, _, _ = near_windows(seqs, None, text, text, k)
        near += [(int(a), int(b), way) for a, b in zip(o, p)]
    near.sort(key=lambda x: (x[0], x[1], -x[2]))
    hits, owner, free = [], -1, 0
    for o, p, way in near:
        if o != owner:
            owner, free = o, 0
        if p >= free:
            hits.append((o, p, way))
            free = p + n
    columns = np.array(hits, np.int64).reshape(-1, 3).T
    return grouped(columns[0], len(seqs), columns[1], columns[2])


def codes(words: np.ndarray) -> np.ndarray:
    """Base-4 number of each row, -1 with another letter; up to 31 letters."""
    digit = LETTER[words].astype(np.int64)
    out = np.zeros(len(words), np.int64)
    for j in range(words.shape[1]):
        out = out * 4 + np.maximum(digit[:, j], 0)
    return np.where((digit < 0).any(1), -1, out) if words.shape[1] else out


class Index:
    """Rows by the number of a part of their word."""

    def __init__(self, code: np.ndarray):
        self.order = np.argsort(code, kind="stable").astype(np.int32)
        self.code = code[self.order]

    def pairs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in code, row) of all equal ones; -1 equals none."""
        first, last = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        n = np.where(code < 0, 0, last - first)
        owner, step = counted(n)
        return owner, self.order[first[owner] + step]


def cut(lengths: Sequence[int]) -> list[slice]:
    ends = np.cumsum(lengths).tolist()
    return [slice(e - n, e) for e, n in zip(ends, lengths)]


def block_edits(size: int) -> np.ndarray:
    """For each number of a block of so many letters, those of the blocks that stand in its place after one edit at most; rows are filled up with itself.

    After a letter is left out, any letter may follow; after one is put in, the last letter moves on."""
    whole = np.arange(4**size)
    digits = [(whole >> 2 * (size - 1 - i)) & 3 for i in range(size)]
    number = lambda xs: sum(x << 2 * (size - 1 - i) for i, x in enumerate(xs))
    out = [whole]
    for i in range(size):
        for c in range(4):
            out.append(number([*digits[:i], c, *digits[i + 1 :]]))
            out.append(number([*digits[:i], *digits[i + 1 :], c]))
            out.append(number([*digits[:i], c, *digits[i:-1]]))
    rows = np.sort(np.stack(out, 1), 1)
    again = np.concatenate([np.zeros((len(rows), 1), bool), rows[:, 1:] == rows[:, :-1]], 1)
    rows = np.where(again | (rows == whole[:, None]), whole[:, None], rows)
    rows = np.sort(np.where(rows == whole[:, None], -1, rows), 1)[:, ::-1]
    rows = rows[:, : int((rows >= 0).sum(1).max())]
    return np.concatenate([whole[:, None], np.where(rows < 0, whole[:, None], rows)], 1).astype(np.int32)


def moved(code: np.ndarray, size: int) -> np.ndarray:
    """The numbers of the blocks of so many letters that equal each given one, or do so where they overlap after a shift by one or two letters."""
    one, two = np.arange(4), np.arange(16)
    code, most = code[:, None], 4**size - 1
    return np.concatenate([code, code << 2 & most | one, code << 4 & most | two, code >> 2 | one << 2 * (size - 1), code >> 4 | two << 2 * (size - 2)], 1)


class Table:
    """Rows by the number of a part of their word, in a table of all numbers."""

    def __init__(self, code: np.ndarray, size: int):
        self.order = np.argsort(code, kind="stable").astype(np.int32)
        self.start = np.zeros(4**size + 1, np.int32)
        np.cumsum(np.bincount(code, minlength=4**size), out=self.start[1:])

    def pairs(self, code: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row in code, row) of all that equal one of the numbers of a row of code."""
        first = self.start[code]
        n = self.start[code + 1] - first
        at = np.flatnonzero(n if wanted is None else n * wanted)
        owner, step = counted(n.ravel()[at])
        return (at // code.shape[1])[owner], self.order[first.ravel()[at][owner] + step]


class Near:
    """Pairs of words of three parts that have a part in common at its place and may be within two edits, the ends free.

    Take the way of edits from the start of a k-mer on. If the first part is equal, either one edit at most lies within the second part, or both do and what
    follows is equal after a shift. If it differs, it holds one edit, and the second or third part is equal; or it holds both, and what follows is equal
    after a shift. Each case is a few numbers to look up, so a k-mer meets some ten words whatever its parts have in common with a long whitelist."""

    def __init__(self, words: np.ndarray, parts: list[slice]):
        self.parts, self.sizes = parts, [p.stop - p.start for p in parts]
        a, b, c = (codes(words[:, p]) for p in parts)
        la, lb, lc = self.sizes
        self.ab, self.ac, self.bc = Table(a << 2 * lb | b, la + lb), Table(a << 2 * lc | c, la + lc), Table(b << 2 * lc | c, lb + lc)
        self.first, self.second = block_edits(la), block_edits(lb)

    @staticmethod
    def fits(lengths: Sequence[int], edits: int) -> bool:
        return edits == 2 and len(lengths) == 3 and min(lengths) >= 3 and max(lengths[0] + max(lengths[1:]), lengths[1] + lengths[2]) <= 12

    def pairs(self, kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k-mer, word), some of them more than once."""
        a, b, c = (codes(kmers[:, p])[:, None] for p in self.parts)
        _, lb, lc = self.sizes
        other = self.first[a[:, 0]]
        differs = other != a
        rest = b << 2 * lc | c
        after = moved(rest[:, 0], lb + lc)
        same = (after >> 2 * lc == b) | (after & 4**lc - 1 == c)
        found = [
            self.ab.pairs(a << 2 * lb | self.second[b[:, 0]]),
            self.ac.pairs(a << 2 * lc | moved(c[:, 0], lc)),
            self.ab.pairs(other << 2 * lb | b, differs),
            self.ac.pairs(other << 2 * lc | c, differs),
            self.bc.pairs(after, same),
        ]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Barcodes:
    """A whitelist in memory: exact and seeded fuzzy matches of k-mers on both strands."""

    PAIRS = 1 << 20
    #: From so many rows on, words that share a segment are looked up with the edits beside it, as most of them are far.
    MANY = 1 << 15

    def __init__(self, ordinals: Sequence[int], names: Sequence[str], lengths: Sequence[int]):
        self.ordinals, self.names, self.length = np.array(ordinals, np.int64), np.array(names, object), sum(lengths)
        self.words = letters("".join(names)).reshape(-1, self.length)
        self.lengths, self.parts = tuple(lengths), cut(lengths)
        self.whole = Index(codes(self.words))
        self.made: dict = {}

    def on(self, way: int) -> np.ndarray:
        """The words of a strand."""
        if way == 0:
            return self.words
        if "back" not in self.made:
            self.made["back"] = OTHER[self.words[:, ::-1]]
        return self.made["back"]

    def seeds(self, way: int) -> list[Index]:
        if ("seeds", way) not in self.made:
            self.made["seeds", way] = [Index(codes(self.on(way)[:, p])) for p in self.parts]
        return self.made["seeds", way]

    def near(self, way: int) -> tuple[Near, np.ndarray, list[Index], np.ndarray]:
        """The words of four letters and their rows, and the others."""
        if ("near", way) not in self.made:
            words = self.on(way)
            plain = codes(words) >= 0
            others = [Index(codes(words[~plain][:, p])) for p in self.parts]
            self.made["near", way] = Near(words[plain], self.parts), np.flatnonzero(plain), others, np.flatnonzero(~plain)
        return self.made["near", way]

    def __getstate__(self) -> dict:
        """Without what a task can make itself."""
        return self.__dict__ | {"made": {}}

    def exact(self, kmers: np.ndarray, strand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k-mer, barcode) of k-mers that are a barcode, or on strand 3 its reverse complement."""
        turned = np.where((strand == 3)[:, None], OTHER[kmers[:, ::-1]], kmers)
        return self.whole.pairs(codes(turned))

    def seeded(self, way: int, kmers: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
        """(k-mer, barcode) of those that share a segment at its place; of long lists only those that may be near."""
        share = lambda seeds, some: [np.concatenate(x) for x in zip(*(i.pairs(codes(kmers[some][:, p])) for i, p in zip(seeds, self.parts)))]
        if len(self.words) < self.MANY or not Near.fits(self.lengths, edits):
            return share(self.seeds(way), slice(None))
        near, rows, other_seeds, others = self.near(way)
        whole = codes(kmers) >= 0
        plain, odd = np.flatnonzero(whole), np.flatnonzero(~whole)
        k, w = near.pairs(kmers[plain])
        found = [(plain[k], rows[w])]
        if len(others):
            k, w = share(other_seeds, plain)
            found.append((plain[k], others[w]))
        if len(odd):
            k, w = share(self.seeds(way), odd)
            found.append((odd[k], w))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def fuzzy(self, kmers: np.ndarray, strand: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k-mer, barcode, edits) of those that share a segment at its place and are within so many edits, the ends free."""
        found: list[tuple] = []
        for way in (0, 3):
            rows, words = np.flatnonzero(strand == way), self.on(way)
            step = 4096
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                k, w = self.seeded(way, kmers[own], edits)
                for j in range(0, len(k), self.PAIRS):
                    a, b = k[j : j + self.PAIRS], w[j : j + self.PAIRS]
                    dist = tail_free(words[b], kmers[own[a]], edits)
                    near = np.flatnonzero(dist <= edits)
                    found.append((own[a[near]], b[near].astype(np.int64), dist[near].astype(np.int64)))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        k, w, dist = (np.concatenate([f[i] for f in found]) for i in range(3))
        _, one = np.unique(k * len(self.words) + w, return_index=True)  # a pair may share several segments
        return k[one], w[one], dist[one]

    def best(self, windows: Sequence[str | None], first: np.ndarray, strand: np.ndarray, edits: int, exact_first: bool) -> list[list[np.ndarray]]:
        """By window: its barcodes with their places, edits and ordinals, each barcode once by its fewest edits, then its first place; fewest edits first,
        ties to the earlier place, then the lower ordinal. With exact_first, windows with an exact match have no others."""
        reads = Reads(windows)
        owner, step = counted(np.maximum(reads.size - self.length + 1, 0))
        at = reads.first[owner] + step
        kmers = np.lib.stride_tricks.sliding_window_view(reads.buffer, self.length)[at] if len(at) else np.zeros((0, self.length), np.uint8)
        way = strand[owner]
        k, b = self.exact(kmers, way)
        e = np.zeros(len(k), np.int64)
        left = np.arange(len(owner))
        if exact_first:
            done = np.zeros(len(reads.size), bool)
            done[owner[k]] = True
            left = left[~done[owner]]
        fk, fb, fe = self.fuzzy(kmers[left], way[left], edits)
        if not exact_first:  # exact ones are among them
            k, b, e = (np.zeros(0, np.int64) for _ in range(3))
        k, b, e = np.concatenate([k, left[fk]]).astype(np.int64), np.concatenate([b, fb]).astype(np.int64), np.concatenate([e, fe])
        own, pos = owner[k], first[owner[k]] + step[k]
        # Each barcode of a window once: names decide, as equal names are one barcode.
        order = np.lexsort((self.ordinals[b], pos, e, own))
        own, pos, b, e = own[order], pos[order], b[order], e[order]
        code = self.whole_code[b]
        _, one = np.unique(own * (code.max() + 1 if len(code) else 1) + code, return_index=True) if len(own) < 2**62 else (None, np.arange(len(own)))
        one = np.sort(one)
        own, pos, b, e = own[one], pos[one], b[one], e[one]
        places = grouped(own, len(reads.size), pos, e)
        cuts = np.searchsorted(own, np.arange(1, len(reads.size)))
        split = lambda v: np.split(v, cuts) if len(reads.size) else []
        return [split(self.names[b]), *places, split(self.ordinals[b])]

    @property
    def whole_code(self) -> np.ndarray:
        """The first row of each row's name."""
        if not hasattr(self, "_same"):
            _, first, inverse = np.unique(self.names.astype(str), return_index=True, return_inverse=True)
            self._same = first[inverse].astype(np.int64)
        return self._same

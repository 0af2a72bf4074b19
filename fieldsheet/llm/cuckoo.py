"""A cuckoo filter in numpy: approximate membership with deletion, no false negatives."""

import pickle

import numpy as np

SLOTS = 4
KICKS = 500


class Table:
    """Buckets of four 16-bit fingerprints; a key's two buckets differ by a hash of its fingerprint."""

    def __init__(self, buckets: int):
        self.cells = np.zeros((buckets, SLOTS), np.uint16)
        self.held = 0

    def places(self, keys):
        mask = np.uint64(len(self.cells) - 1)
        prints = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        first = keys & mask
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ ((prints.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.cells) - 1))

    def contains(self, keys):
        prints, a, b = self.places(keys)
        return ((self.cells[a] == prints[:, None]) | (self.cells[b] == prints[:, None])).any(axis=1)

    def _settle(self, prints, bucket):
        """Put what fits into free slots of ``bucket``; returns what did not fit."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order].astype(np.int64)
        new = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0)) if len(b) else np.zeros(0, int)
        rank = np.arange(len(b)) - start
        free = SLOTS - np.count_nonzero(self.cells, axis=1)
        fits = rank < free[b]
        for r in range(SLOTS):  # the r-th free slot of every bucket at once
            now = order[fits & (rank == r)]
            rows = bucket[now].astype(np.int64)
            slot = (self.cells[rows] == 0).argmax(axis=1)
            self.cells[rows, slot] = prints[now]
        self.held += int(fits.sum())
        return order[~fits]

    def insert(self, keys):
        """Insert ``keys``; returns the positions that found no place."""
        prints, a, b = self.places(keys)
        left = self._settle(prints, a)
        left = left[self._settle(prints[left], b[left])]
        rest, rng = [], np.random.default_rng(len(keys))
        for i in left:
            if self.held > 0.94 * self.cells.size or not self._kick(prints[i], b[i], rng):
                rest.append(i)
        return np.array(rest, np.int64)

    def _kick(self, mark, bucket, rng):
        trail = []
        for _ in range(KICKS):
            row = self.cells[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = mark
                self.held += 1
                return True
            slot = rng.integers(SLOTS)
            trail.append((bucket, slot, row[slot]))
            row[slot], mark = mark, row[slot]
            bucket = self.other(bucket, np.uint16(mark))
        for where, slot, old in reversed(trail):  # no place: undo, so that nothing that was there is lost
            self.cells[where, slot] = old
        return False

    def delete(self, keys):
        """Remove one fingerprint per key; returns the positions that were not found."""
        missing = []
        prints, a, b = self.places(keys)
        for i in range(len(keys)):
            for bucket in (a[i], b[i]):
                at = np.flatnonzero(self.cells[bucket] == prints[i])
                if len(at):
                    self.cells[bucket, at[0]] = 0
                    self.held -= 1
                    break
            else:
                missing.append(i)
        return np.array(missing, np.int64)


class CuckooFilter:
    """Tables of doubling size: a full one is kept and the next one takes the rest."""

    def __init__(self, expected: int = 0):
        self.tables = []
        self.next = 1 << max(6, int(np.ceil(np.log2(max(1, expected) / SLOTS / 0.8 + 1))))

    def contains(self, keys):
        keys = np.asarray(keys, np.uint64)
        found = np.zeros(len(keys), bool)
        for t in self.tables:
            found |= t.contains(keys)
        return found

    def insert(self, keys):
        keys = np.asarray(keys, np.uint64)
        if self.tables and len(keys):
            keys = keys[self.tables[-1].insert(keys)]
        while len(keys):
            self.next = max(self.next, 1 << int(np.ceil(np.log2(len(keys) / SLOTS / 0.8 + 1))))
            self.tables.append(Table(self.next))
            self.next *= 2
            keys = keys[self.tables[-1].insert(keys)]

    def delete(self, keys):
        keys = np.asarray(keys, np.uint64)
        for t in reversed(self.tables):
            if len(keys):
                keys = keys[t.delete(keys)]
        if len(keys):
            raise ValueError("a key was deleted that was never inserted")

    def dump(self) -> bytes:
        return pickle.dumps((self.next, [(t.cells, t.held) for t in self.tables]))

    @classmethod
    def load(cls, blob: bytes | None) -> "CuckooFilter":
        out = cls()
        if blob is not None:
            out.next, tables = pickle.loads(blob)
            for cells, held in tables:
                t = Table(1)
                t.cells, t.held = cells.copy(), held
                out.tables.append(t)
        return out

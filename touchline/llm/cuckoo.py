"""Cuckoo filters over 64-bit keys: counted membership with deletion, in numpy.

A key has a 16-bit fingerprint and two buckets of four places, each found from
the other and the fingerprint.  A key may be in several times, so the number of
its fingerprints in its buckets is never less than its copies, and seldom more.
Batches go in by rounds: all waiting keys try a free place of their bucket at
once, and what finds none changes places with a resident that moves on.
"""

from __future__ import annotations

import numpy as np

from touchline.llm.shared import mix64

PLACES = 4
FULLEST = 0.85
ROUNDS = 500


class Full(Exception):
    """Keys that found no place."""


def _rank(group: np.ndarray) -> np.ndarray:
    """The number of equal values before each one."""
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(group) else np.zeros(0, np.int64)
    rank = np.empty(len(group), np.int64)
    rank[order] = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return rank


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, copies: int) -> CuckooFilter:
        """An empty filter with room for so many copies."""
        buckets = 1
        while buckets * PLACES * FULLEST < copies:
            buckets *= 2
        return cls(np.zeros((buckets, PLACES), np.uint16))

    @classmethod
    def loaded(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, PLACES).copy())

    @classmethod
    def built(cls, keys: np.ndarray, copies: np.ndarray) -> CuckooFilter:
        room = int(copies.sum())
        while True:
            filter_ = cls.sized(room)
            try:
                filter_.insert(keys, copies)
                return filter_
            except Full:
                room = len(filter_.table) * PLACES * 2

    def blob(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(print_.astype(np.uint64)) & self.mask)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and both buckets."""
        print_ = np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        one = keys & self.mask
        return print_, one, self._other(one, print_)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """At least the copies of each key."""
        print_, one, two = self._places(keys)
        here = (self.table[one] == print_[:, None]).sum(axis=1)
        return here + np.where(one == two, 0, (self.table[two] == print_[:, None]).sum(axis=1))

    def insert(self, keys: np.ndarray, copies: np.ndarray) -> None:
        """Adds copies of keys; raises Full, with the table in no useful state, if there is no room."""
        print_, at, _ = self._places(np.repeat(keys, copies))
        at, print_ = self._settled(at, print_)
        at = self._other(at, print_)
        for turn in range(ROUNDS):
            at, print_ = self._settled(at, print_)
            if not len(at):
                return
            ahead = _rank(at) == 0  # one a bucket takes a resident's place, the others wait
            place = (mix64(at[ahead] + np.uint64(turn)) % np.uint64(PLACES)).astype(np.int64)
            moved = self.table[at[ahead], place]
            self.table[at[ahead], place] = print_[ahead]
            print_[ahead] = moved
            at[ahead] = self._other(at[ahead], moved)
        raise Full

    def _settled(self, at: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts keys into free places of their buckets; those left over."""
        rank = _rank(at)
        free = self.table[at] == 0
        fits = rank < free.sum(axis=1)
        place = (np.cumsum(free[fits], axis=1) == (rank[fits] + 1)[:, None]).argmax(axis=1)
        self.table[at[fits], place] = print_[fits]
        return at[~fits], print_[~fits]

    def delete(self, keys: np.ndarray, copies: np.ndarray) -> None:
        """Takes out copies of keys, which must be in."""
        print_, one, two = self._places(np.repeat(keys, copies))
        low, high = np.minimum(one, two), np.maximum(one, two)
        rank = _rank(mix64(low) ^ print_.astype(np.uint64))
        held = np.concatenate([self.table[low] == print_[:, None], (self.table[high] == print_[:, None]) & (low != high)[:, None]], axis=1)
        place = (np.cumsum(held, axis=1) == (rank + 1)[:, None]).argmax(axis=1)
        self.table[np.where(place < PLACES, low, high), place % PLACES] = 0

"""A cuckoo filter over 128-bit keys given as two 64-bit numbers."""

from __future__ import annotations

import numpy as np

SLOTS, KICKS = 4, 500


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


class Full(Exception):
    pass


class CuckooFilter:
    """16-bit fingerprints, four to a bucket. ``k1`` chooses the bucket, ``k2``
    the fingerprint; equal fingerprints are stored as often as they are added, so
    each addition can be taken back."""

    def __init__(self, buckets: int, data: bytes | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = (
            np.zeros((buckets, SLOTS), np.uint16) if data is None
            else np.frombuffer(data, np.uint16).reshape(buckets, SLOTS).copy()
        )

    @staticmethod
    def buckets_for(keys: int) -> int:
        return 1 << max(2, int(keys / SLOTS / 0.85)).bit_length()

    def prints(self, k1: np.ndarray, k2: np.ndarray):
        finger = (k2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        finger = np.where(finger == 0, np.uint16(1), finger)
        first = mixed(k1.astype(np.uint64)) & self.mask
        return finger, first, first ^ (mixed(finger.astype(np.uint64)) & self.mask)

    def add(self, k1: np.ndarray, k2: np.ndarray) -> None:
        turn = 12345
        for finger, one, two in zip(*(x.tolist() for x in self.prints(k1, k2))):
            at = one
            for kick in range(KICKS):
                bucket = self.table[at]
                room = np.flatnonzero(bucket == 0)
                if not len(room) and kick == 0:
                    at = two
                    bucket = self.table[at]
                    room = np.flatnonzero(bucket == 0)
                if len(room):
                    bucket[room[0]] = finger
                    break
                turn = (turn * 1103515245 + 12345) & 0x7FFFFFFF
                slot = (turn >> 16) % SLOTS
                finger, bucket[slot] = int(bucket[slot]), finger
                at = int(np.uint64(at) ^ (mixed(np.array([finger], np.uint64))[0] & self.mask))
            else:
                raise Full

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for finger, one, two in zip(*(x.tolist() for x in self.prints(k1, k2))):
            for at in (one, two):
                there = np.flatnonzero(self.table[at] == finger)
                if len(there):
                    self.table[at][there[0]] = 0
                    break

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        finger, one, two = self.prints(k1, k2)
        finger = finger[:, None]
        return ((self.table[one] == finger) | (self.table[two] == finger)).any(axis=1)


def built(k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
    """A filter of these keys; it doubles until all fit."""
    buckets = CuckooFilter.buckets_for(len(k1))
    while True:
        made = CuckooFilter(buckets)
        try:
            made.add(k1, k2)
            return made
        except Full:
            buckets *= 2

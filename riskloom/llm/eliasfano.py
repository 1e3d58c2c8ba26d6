"""Elias-Fano lists: sorted numbers in near-minimal space with direct access."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many-th set bit of the upper part has its place noted.
SAMPLE = 256
HEAD = struct.Struct("<qQQB")


class EliasFano:
    """A sorted list of integers.

    Each number less the first is cut into ``low`` lower bits, stored side by
    side, and an upper part, stored in unary: number ``i`` with upper part
    ``u`` sets bit ``u + i``. Noted places of every 256th set bit (32 bits
    each, the upper part has at most about three bits per number) start the
    search of ``select``.
    """

    def __init__(self, base: int, count: int, length: int, low: int, lows: np.ndarray, highs: np.ndarray):
        self.base, self.count, self.length, self.low = base, count, length, low
        self.lows, self.highs = lows, highs
        self.samples = np.flatnonzero(self._bits())[::SAMPLE].astype(np.uint32)

    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.highs, count=self.length, bitorder="little")

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, np.int64)
        count = len(numbers)
        if not count:
            return cls(0, 0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        base = int(numbers[0])
        rest = numbers.astype(np.uint64) - np.uint64(base & 0xFFFF_FFFF_FFFF_FFFF)
        low = max(0, (int(rest[-1]) // count).bit_length() - 1)
        if low:
            places = np.arange(low, dtype=np.uint64)
            lows = np.packbits(((rest[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        else:
            lows = np.zeros(0, np.uint8)
        upper = (rest >> np.uint64(low)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(upper[-1]) + 1, np.uint8)
        bits[upper] = 1
        return cls(base, count, len(bits), low, lows, np.packbits(bits, bitorder="little"))

    def select(self, i: int) -> int:
        """Number ``i``, from the noted place before it."""
        byte, wanted = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = byte // 8
        seen = int(self.highs[at] & ((1 << byte % 8) - 1)).bit_count()
        wanted += seen
        while (ones := int(self.highs[at]).bit_count()) <= wanted:
            wanted -= ones
            at += 1
        byte, place = int(self.highs[at]), -1
        for _ in range(wanted + 1):
            place = (byte >> (place + 1) & -(byte >> (place + 1))).bit_length() + place
        value = (8 * at + place - i) << self.low
        first = i * self.low
        part = int.from_bytes(self.lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little")
        return self.base + (value | part >> first % 8 & ((1 << self.low) - 1))

    def numbers(self) -> np.ndarray:
        """The whole list."""
        values = np.flatnonzero(self._bits()) - np.arange(self.count)
        values = values.astype(np.uint64) << np.uint64(self.low)
        if self.low and self.count:
            bits = np.unpackbits(self.lows, count=self.count * self.low, bitorder="little").reshape(-1, self.low)
            values |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (values + np.uint64(self.base & 0xFFFF_FFFF_FFFF_FFFF)).astype(np.int64)

    def to_bytes(self) -> bytes:
        return HEAD.pack(self.base, self.count, self.length, self.low) + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        base, count, length, low = HEAD.unpack_from(data)
        middle = HEAD.size + (count * low + 7) // 8
        lows = np.frombuffer(data, np.uint8, middle - HEAD.size, HEAD.size)
        highs = np.frombuffer(data, np.uint8, (length + 7) // 8, middle)
        return cls(base, count, length, low, lows, highs)

"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block of ids is dealt over `lanes` coders: id k belongs to lane k mod lanes, step k div lanes. All coders share one
frequency table of 2**precision slots and one stream of 32-bit words, which the decoder takes from step by step, in order of lanes. Checkpoints hold
the decoder's states and place in the stream before every CHECK-th step, so that parts of a block can be decoded on their own.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

LANES, CHECK, LOW = 2048, 128, 1 << 31
U = np.uint64


@dataclass
class Table:
    """Shared frequencies: of each id, their running sums, and the id of each slot."""

    precision: int
    freq: np.ndarray
    start: np.ndarray
    slot: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, precision: int = 20) -> Table:
        """Frequencies in proportion to the counts, 1 at least for each id that occurs."""
        used = np.flatnonzero(counts)
        freq = np.zeros(len(counts), np.int64)
        if len(used):
            while len(used) * 2 > 1 << precision:
                precision += 1
            room = (1 << precision) - len(used)
            freq[used] = 1 + np.floor(counts[used].astype(np.float64) * (room / counts[used].sum())).astype(np.int64)
            freq[used[np.argmax(freq[used])]] += (1 << precision) - freq.sum()
        start = np.cumsum(freq) - freq
        return cls(precision, freq.astype(U), start.astype(U), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


@dataclass
class Block:
    n: int
    lanes: int
    words: bytes
    checkpoints: list[tuple[int, bytes]]
    checksum: int


def encode(ids: np.ndarray, table: Table, lanes: int = LANES) -> Block:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    rows = -(-n // lanes)
    padded = np.full(rows * lanes, table.freq.argmax(), np.int64)
    padded[:n] = ids
    padded = padded.reshape(rows, lanes)
    p, state = U(table.precision), np.full(lanes, LOW, U)
    limit = U((LOW >> table.precision) << 32)
    out, places, taken = [], [], 0
    for step in range(rows - 1, -1, -1):
        f, c = table.freq[padded[step]], table.start[padded[step]]
        full = state >= limit * f
        low = state[full]
        if len(low):
            out.append(low.astype(np.uint32))
            taken += len(low)
            state[full] = low >> U(32)
        q, r = np.divmod(state, f)
        state = (q << p) + r + c
        if step % CHECK == 0:
            places.append((taken, state.astype("<u8").tobytes()))
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    checkpoints = [(taken - at, states) for at, states in reversed(places)]
    return Block(n, lanes, stream.astype("<u4").tobytes(), checkpoints, zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()))


def decode(block: Block, table: Table, first: int = 0, last: int | None = None, verify: bool = True) -> np.ndarray:
    """The ids from checkpoint `first` up to checkpoint `last`; the whole block, with its checksum verified, by default."""
    rows = -(-block.n // block.lanes)
    if not block.n:
        return np.zeros(0, np.uint32)
    at, states = block.checkpoints[first]
    state, words = np.frombuffer(states, "<u8").astype(U), np.frombuffer(block.words, "<u4")
    begin, end = first * CHECK, rows if last is None else min(rows, last * CHECK)
    out = np.empty((end - begin, block.lanes), np.uint32)
    p, mask = U(table.precision), U((1 << table.precision) - 1)
    for step in range(end - begin):
        slot = state & mask
        ids = out[step] = table.slot[slot]
        state = table.freq[ids] * (state >> p) + slot - table.start[ids]
        empty = np.flatnonzero(state < LOW)
        if len(empty):
            state[empty] = state[empty] << U(32) | words[at : at + len(empty)]
            at += len(empty)
    out = out.ravel()[: block.n - begin * block.lanes]
    if verify and first == 0 and last is None and zlib.crc32(np.ascontiguousarray(out, "<u4").tobytes()) != block.checksum:
        raise ValueError("checksum of a block of ids doesn't match")
    return out

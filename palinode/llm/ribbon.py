"""Ribbon filters in numpy: keys to fingerprints through banded linear systems over GF(2).

A key has a start, a band of ``WIDTH`` coefficients and a fingerprint; the filter stores a solution Z of the system in
which the XOR of Z at the key's set coefficients is its fingerprint. Keys are spread over blocks of about ``BLOCK`` keys,
each a system of its own, and all blocks of a filter are eliminated in lockstep, one array operation for all.
A stored key is always recognised; another is taken for a stored one with probability 2**-bits.
"""

from __future__ import annotations

import numpy as np

WIDTH = 32
BLOCK = 512
_U = np.uint64
_TYPES = {8: np.uint8, 16: np.uint16, 32: np.uint32}


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _U(by)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashes(h1: np.ndarray, h2: np.ndarray, seed: int, blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Block, position within the block as a 32-bit fraction, coefficients and fingerprint."""
    a = _mixed(h1.view(np.uint64), 0x9E3779B97F4A7C15)
    block = ((a >> _U(32)) * _U(blocks)) >> _U(32)
    b = _mixed(h2.view(np.uint64) ^ a, 2 * seed + 1)
    c = _mixed(b, 0x632BE59BD9B4E019)
    return block.astype(np.int64), b >> _U(32), (b & _U(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), (c & _U((1 << bits) - 1)).astype(np.uint32)


def _eliminate(lengths: np.ndarray, counts: np.ndarray, start: np.ndarray, coef: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the triangular systems; False if some system has no solution. Keys come by block and start."""
    offset = np.cumsum(lengths) - lengths
    rows, rights = np.zeros(int(lengths.sum()), np.uint32), np.zeros(int(lengths.sum()), np.uint32)
    first = np.cumsum(counts) - counts
    last = first + counts
    block = np.flatnonzero(counts)
    at = first[block]
    s, c, r = start[at] + offset[block], coef[at], print_[at]
    while len(block):
        there = rows[s]
        free = there == 0
        rows[s[free]], rights[s[free]] = c[free], r[free]
        c = np.where(free, np.uint32(0), c ^ there)
        r = np.where(free, np.uint32(0), r ^ rights[s])
        if ((c == 0) & (r != 0)).any():
            return rows, rights, False
        done = c == 0  # stored, or the same key again
        low = np.frexp((c & (~c + np.uint32(1))).astype(np.float64))[1] - 1
        step = np.where(done, 0, low)
        c, s = c >> step.astype(np.uint32), s + step
        if done.any():
            at = at + done
            fresh = done & (at < last[block])
            nxt = at[fresh]
            s[fresh], c[fresh], r[fresh] = start[nxt] + offset[block[fresh]], coef[nxt], print_[nxt]
            stay = ~done | fresh
            if not stay.all():
                block, at, s, c, r = block[stay], at[stay], s[stay], c[stay], r[stay]
    return rows, rights, True


def _solve(lengths: np.ndarray, rows: np.ndarray, rights: np.ndarray, bits: int) -> np.ndarray:
    """Back substitution from the last column of every block at once; per block the last WIDTH solutions, bit by bit."""
    offset = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    solution = np.zeros(len(rows), np.uint32)
    window = np.zeros((len(lengths), bits), np.uint32)
    shifts = np.arange(bits, dtype=np.uint32)
    weights = (np.uint32(1) << shifts).astype(np.uint32)
    for back in range(1, int(sorted_lengths[0]) + 1):
        live = int(np.searchsorted(-sorted_lengths, -back, side="right"))
        which = order[:live]
        at = offset[which] + lengths[which] - back
        c = rows[at]
        old = window[:live]
        bit = (np.bitwise_count((c >> np.uint32(1))[:, None] & old).astype(np.uint32) & np.uint32(1)) ^ ((rights[at][:, None] >> shifts) & np.uint32(1))
        # a column without a row is free: its solution is 0
        bit = np.where((c == 0)[:, None], np.uint32(0), bit)
        window[:live] = (old << np.uint32(1)) | bit
        solution[at] = (bit * weights).sum(axis=1, dtype=np.uint32)
    return solution


def build(h1: np.ndarray, h2: np.ndarray, bits: int) -> bytes:
    """The filter of the keys with the 64-bit hashes ``h1``, ``h2``; repeated keys count once."""
    n = len(h1)
    blocks = max(1, -(-n // BLOCK))
    slack = 1.12
    for seed in range(1, 200):
        block, spot, coef, print_ = _hashes(h1, h2, seed, blocks, bits)
        counts = np.bincount(block, minlength=blocks).astype(np.int64)
        lengths = (counts * slack).astype(np.int64) + WIDTH + 8
        start = ((spot * (lengths[block] - WIDTH + 1).astype(np.uint64)) >> _U(32)).astype(np.int64)
        order = np.lexsort((start, block))
        rows, rights, solved = _eliminate(lengths, counts, start[order], coef[order], print_[order])
        if solved:
            head = np.array([seed, blocks, bits], np.uint32).tobytes() + lengths.astype(np.uint32).tobytes()
            return head + _solve(lengths, rows, rights, bits).astype(_TYPES[bits]).tobytes()
        slack += 0.02
    raise ValueError("no ribbon system of these keys can be solved")


def probe(blob: bytes, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys the filter takes for stored."""
    seed, blocks, bits = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    lengths = np.frombuffer(blob, np.uint32, blocks, 12).astype(np.int64)
    solution = np.frombuffer(blob, _TYPES[bits], offset=12 + 4 * blocks)
    block, spot, coef, print_ = _hashes(h1, h2, seed, blocks, bits)
    offset = np.cumsum(lengths) - lengths
    at = offset[block] + ((spot * (lengths[block] - WIDTH + 1).astype(np.uint64)) >> _U(32)).astype(np.int64)
    got = np.zeros(len(h1), np.uint32)
    for j in range(WIDTH):
        got ^= solution[at + j] * ((coef >> np.uint32(j)) & np.uint32(1))
    return got == print_

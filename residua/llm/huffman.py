"""Canonical, length-limited Huffman codes over integer symbols, packed and read in bulk.

Lengths come from package-merge, so no code is longer than the limit and the total is least among such codes.
Codes are canonical: shorter first, then by symbol, so the lengths alone are the code book. A decoder looks the
next ``limit`` bits up in a table. Bits are packed from the most significant one of each byte.
"""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Length of every symbol's code, 0 where the count is 0; ``limit`` is raised where it cannot tell the symbols apart."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels = []
    merged, single = weights, np.ones(len(weights), bool)
    for _ in range(limit):
        levels.append(single)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        at = np.argsort(both, kind="stable")
        merged, single = both[at], at < len(weights)
    # of the last list the first 2n - 2 items are taken; its packages name how many of the list before
    taken, depth = 2 * len(used) - 2, np.zeros(len(order) + 1, np.int64)
    for single in reversed(levels):
        leaves = int(single[:taken].sum())
        depth[0] += 1
        depth[leaves] -= 1
        taken = 2 * (taken - leaves)
    lengths[order] = np.cumsum(depth[:-1])
    return lengths


class Code:
    """The canonical code of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        sizes = self.lengths[order]
        self.limit = int(sizes.max(initial=1))
        # a code is the share of the code space before it
        before = np.cumsum(1 << (self.limit - sizes)) - (1 << (self.limit - sizes))
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (before >> (self.limit - sizes)).astype(np.uint64)
        table = np.repeat(order << 8 | sizes, 1 << (self.limit - sizes))
        self.table = np.zeros(1 << self.limit, np.int64)
        self.table[: len(table)] = table

    def pack(self, symbols: np.ndarray, sizes: np.ndarray, block: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Bits of consecutive groups of ``symbols``, each group from a byte of its own on.

        Also the bytes of each group, the bit offset in its group of every block of ``block`` symbols, and the number of blocks of each group.
        """
        bits = self.lengths[symbols]
        if len(bits) and bits.min() == 0:
            raise ValueError("a symbol is not in the code book")
        running = np.concatenate([[0], np.cumsum(bits)])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        group_bits = running[ends] - running[starts]
        group_bytes = (group_bits + 7) >> 3
        base = (np.cumsum(group_bytes) - group_bytes) << 3
        at = running[:-1] + np.repeat(base - running[starts], sizes)
        words = np.zeros(int(group_bytes.sum()) // 4 + 2, np.uint32)
        if len(symbols):
            word = at >> 5
            wide = self.codes[symbols] << (64 - (at & 31) - bits).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] |= np.bitwise_or.reduceat((wide >> np.uint64(32)).astype(np.uint32), first)
            words[word[first] + 1] |= np.bitwise_or.reduceat(wide.astype(np.uint32), first)
        blocks = -(-sizes // block)
        nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        heads = np.repeat(starts, blocks) + nth * block
        return words.astype(">u4").tobytes()[: int(group_bytes.sum())], group_bytes, at[heads] - np.repeat(base, blocks), blocks

    def unpack(self, data: bytes, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Symbols of blocks that start at bit ``offsets`` and hold ``counts`` symbols, one block after the other.

        All blocks advance together, a symbol a step: blocks do not depend on each other.
        """
        padded = data + b"\0" * (12 - len(data) % 4)
        words = np.frombuffer(padded, ">u4").astype(np.uint64)
        pairs = words[:-1] << np.uint64(32) | words[1:]
        out = np.empty(int(counts.sum()), np.int64)
        longest_first = np.argsort(-counts, kind="stable")
        at = offsets[longest_first].astype(np.int64)
        place = (np.cumsum(counts) - counts)[longest_first]
        alive = np.searchsorted(-counts[longest_first], -np.arange(1, int(counts.max(initial=0)) + 1), side="right")
        for step, n in enumerate(alive.tolist()):
            at = at[:n]
            window = pairs[at >> 5] >> (64 - self.limit - (at & 31)).astype(np.uint64)
            found = self.table[(window & np.uint64((1 << self.limit) - 1)).astype(np.int64)]
            out[place[:n] + step] = found >> 8
            at = at + (found & 255)
        return out

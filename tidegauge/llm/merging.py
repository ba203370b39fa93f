"""Rank-synchronous BPE merging of many words held as one ragged array."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A word of more characters needs as many rounds; callers merge it with a heap instead, with equal results.
ROUND_CHARS = 64
_NEVER = np.int64(1) << 40
_PLACE = 22


class MergeRanks:
    """Symbols as integers, and the rank and result of every pair of symbols that forms a piece.

    `ranks` gives every piece its rank; single characters that are no piece are symbols too.
    """

    def __init__(self, ranks: dict[str, int]):
        names = set(ranks)
        for piece in ranks:
            names.update(piece)
        self.names = sorted(names)
        self.symbol = {name: i for i, name in enumerate(self.names)}
        self.spare, self.width = len(self.symbol), len(self.symbol) + 1
        keys, order, results = [], [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    order.append(rank)
                    results.append(self.symbol[piece])
        by = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[by]
        self.ranks, self.results = np.array(order, np.int64)[by], np.array(results, np.int64)[by]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NEVER), self.results[at]

    def survivors(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words in order, and how many each word has.

        In every round each word's pair of lowest rank, the leftmost of equals, is found by a
        segmented minimum, and all words apply theirs at once. Only the pairs beside a merge change.
        A character outside the vocabulary is the symbol `spare`.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        symbol, spare = self.symbol, self.spare
        flat = np.array([symbol.get(c, spare) for c in "".join(words)], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(flat))
        rank, result = np.full(len(flat), _NEVER), np.zeros(len(flat), np.int64)
        if len(flat) > 1:
            rank[:-1], result[:-1] = self.look_up(flat[:-1], flat[1:])
            rank[:-1][owner[:-1] != owner[1:]] = _NEVER
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(flat):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(flat)))
            best = np.minimum.reduceat((rank << _PLACE) | (np.arange(len(flat)) - np.repeat(starts, lengths)), starts)
            live = (best >> _PLACE) < _NEVER
            keep = np.repeat(live, lengths)
            if not live.all():
                ended.append((flat[~keep], owner[~keep], place[~keep]))
            at = starts[live] + (best[live] & ((1 << _PLACE) - 1))
            flat[at] = result[at]
            keep[at + 1] = False
            index = np.cumsum(keep) - 1
            flat, owner, place, rank, result = flat[keep], owner[keep], place[keep], rank[keep], result[keep]
            # The merged symbol pairs anew with the one after it, and the one before it with the merged symbol.
            left = np.concatenate([index[at], np.maximum(index[at] - 1, 0)])
            right = np.minimum(left + 1, len(flat) - 1)
            rank[left], result[left] = self.look_up(flat[left], flat[right])
            rank[left[(owner[left] != owner[right]) | (left == right)]] = _NEVER
        symbols, owners, places = (np.concatenate(x) for x in zip(*ended)) if ended else [np.zeros(0, np.int64)] * 3
        return symbols[np.argsort(places, kind="stable")], np.bincount(owners, minlength=len(words))

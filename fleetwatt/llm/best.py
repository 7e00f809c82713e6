"""The k first of each of many keys, kept in arrays inside a task."""

from __future__ import annotations

import numpy as np

#: Least number; stands for "none yet".
NONE = np.iinfo(np.int64).min


class Best:
    """The k first (score, id) of each of many keys, by score from the highest and then by id."""

    def __init__(self, keys: int, k: int):
        self.k, self.least = k, np.full(keys, NONE)
        self.kept = [np.zeros(0, np.int64) for _ in range(4)]
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray, score: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        self.new.append([key, score, ident, uid])
        self.waiting += len(key)
        if self.waiting > max(1 << 16, len(self.kept[0])):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        if self.new:
            key, score, ident, uid = (np.concatenate(c) for c in zip(self.kept, *self.new, strict=True))
            order = np.lexsort((uid, ident, -score, key))
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            keep = rank < self.k
            self.kept = [key[keep], score[order][keep], ident[order][keep], uid[order][keep]]
            last = rank[keep] == self.k - 1
            self.least[self.kept[0][last]] = self.kept[1][last]
            self.new, self.waiting = [], 0
        return self.kept

"""Blocks of sets that are compared with streams of others, all pairs at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Sets, and tokens in them, that meet a block at once.
PROBES = 256
PROBE_TOKENS = 32_000


class Block:
    """Sets (key, tokens, size, component) of which every one meets every probe.

    Tokens are distinct in a set; such as can't be shared may be left out, size counts them all the same. Shared
    tokens are counted exactly: for tokens that many sets of the block hold by a product of 0/1 matrices, for others by
    their lists of sets. Links are reported until they connect what they must: sets known to be connected, by their
    components or by links reported before, are one group, and a probe gets one link to each group but its own.
    """

    def __init__(self, sets: Sequence[tuple[int, np.ndarray, int, int]], num: int, den: int) -> None:
        self.num, self.den, self.n = num, den, len(sets)
        self.keys = [s[0] for s in sets]
        self.sizes = np.array([s[2] for s in sets], np.int64)
        flat = np.concatenate([s[1] for s in sets])
        owner = np.repeat(np.arange(self.n), [len(s[1]) for s in sets])
        self.words, at = np.unique(flat, return_inverse=True)
        self.held = np.bincount(at, minlength=len(self.words))
        self.starts = np.cumsum(self.held) - self.held
        self.owners = owner[np.argsort(at, kind="stable")]
        often = self.held >= max(16, self.n // 8)
        self.column = np.where(often, np.cumsum(often) - 1, -1)
        self.matrix = np.zeros((self.n, int(often.sum())), np.float32)
        mine = often[at]
        self.matrix[owner[mine], self.column[at[mine]]] = 1
        self.of: dict[int, int] = {}  # a component and one set of it
        self.group = np.array([self.of.setdefault(s[3], i) for i, s in enumerate(sets)], np.int64)

    def shared(self, tokens: Sequence[np.ndarray]) -> np.ndarray:
        """How many tokens each of the given sets shares with each of the block. Counts stay below 2**24, so float32 is exact."""
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        known = self.words[at] == flat
        at, owner = at[known], owner[known]
        column = self.column[at]
        often = column >= 0
        rows = np.zeros((len(tokens), self.matrix.shape[1]), np.float32)
        rows[owner[often], column[often]] = 1
        out = (rows @ self.matrix.T).astype(np.int64)
        at, owner = at[~often], owner[~often]
        many = self.held[at]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[at], many)
        pairs = np.repeat(owner, many) * self.n + self.owners[place]
        return out + np.bincount(pairs, minlength=out.size).reshape(out.shape)

    def linked(self, sets: Sequence[tuple[int, np.ndarray, int, int]]) -> list[tuple[int, int]]:
        """(key of a given set, key of a set of the block) for links to each group that isn't the given set's own."""
        out, at, tokens = [], 0, 0
        for i, s in enumerate(sets):
            if i > at and (i - at >= PROBES or tokens + len(s[1]) > PROBE_TOKENS):
                out += self._linked(sets[at:i])
                at, tokens = i, 0
            tokens += len(s[1])
        return out + (self._linked(sets[at:]) if sets else [])

    def _linked(self, sets: Sequence[tuple[int, np.ndarray, int, int]]) -> list[tuple[int, int]]:
        shared = self.shared([s[1] for s in sets])
        sizes = np.array([s[2] for s in sets], np.int64)
        like = self.den * shared >= self.num * (sizes[:, None] + self.sizes - shared)
        out = []
        for i in np.flatnonzero(like.any(axis=1)):
            key, comp = sets[i][0], sets[i][3]
            own = self.group[self.of[comp]] if comp in self.of else -1
            found = np.flatnonzero(like[i])
            groups, first = np.unique(self.group[found], return_index=True)
            new = groups != own
            out += [(key, self.keys[j]) for j in found[first[new]]]
            joined = groups if own < 0 else np.append(groups, own)
            if len(joined) > 1:
                self.group[np.isin(self.group, joined)] = joined.min()
            if own < 0:  # the component has joined these from now on
                self.of[comp] = int(found[0])
        return out

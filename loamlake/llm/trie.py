"""A compressed prefix tree of ordered sets, probed for sets of a given Jaccard similarity."""

from __future__ import annotations

from collections.abc import Sequence


class _Node:
    __slots__ = ("at", "ends", "group", "kids", "least", "long", "most", "run")

    def __init__(self, run: tuple, at: int) -> None:
        self.run, self.at = run, at  # tokens on the way into this node, and how many come before them
        self.kids: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.least, self.most, self.long = 1 << 62, 0, 0  # set sizes and token counts below
        self.group: int | None = -1  # the one group of all sets below; None if there are several


class PrefixTree:
    """Sets are sequences of tokens in one global order, with the full size of each set.

    Tokens that can't be shared may be left out of the sequences; size counts them all the same. Sets that
    were found connected form groups; a probe reports one link to each group that it links with, so a
    cluster of thousands of like sets costs one comparison each instead of one for every pair. Sets that are
    known to be connected from elsewhere come with the same component and are one group from the start.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den  # linked: den * shared >= num * union
        self.root = _Node((), 0)
        self.owner: list[int] = []
        self.keys: list = []
        self.sizes: list[int] = []
        self.visits = 0
        self.component: dict[int, int] = {}  # a component and one set of it

    def find(self, i: int) -> int:
        while self.owner[i] != i:
            self.owner[i] = self.owner[self.owner[i]]
            i = self.owner[i]
        return i

    def add(self, key, tokens: Sequence[int], size: int, component: int | None = None) -> list:
        """Stores the set; returns the keys of earlier sets that it links with, one from each group but its component's."""
        linked = self.probe(tokens, size, component)
        me = len(self.keys)
        self.keys.append(key)
        self.sizes.append(size)
        self.owner.append(me)
        same = [] if component is None else [self.component.setdefault(component, me)]
        for other in [*linked, *same]:
            a, b = self.find(other), self.find(me)
            self.owner[max(a, b)] = min(a, b)
        self._insert(tuple(tokens), size, me)
        return [self.keys[i] for i in linked]

    def _insert(self, tokens: tuple, size: int, me: int) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.most, node.long = min(node.least, size), max(node.most, size), max(node.long, len(tokens))
            if at == len(tokens):
                node.ends.append(me)
                return
            kid = node.kids.get(tokens[at])
            if kid is None:
                kid = node.kids[tokens[at]] = _Node(tokens[at:], at)
                node, at = kid, len(tokens)
                continue
            run, k = kid.run, 1
            while k < len(run) and at + k < len(tokens) and run[k] == tokens[at + k]:
                k += 1
            if k < len(run):  # part of the run is shared: split it
                upper = _Node(run[:k], at)
                upper.least, upper.most, upper.long = kid.least, kid.most, kid.long
                kid.run, kid.at = run[k:], at + k
                upper.kids[run[k]] = kid
                node.kids[tokens[at]] = kid = upper
            node, at = kid, at + k

    def probe(self, tokens: Sequence[int], size: int, component: int | None = None) -> list[int]:
        """Numbers of stored sets that link with this one, one from each group but its component's."""
        place = {t: i for i, t in enumerate(tokens)}
        found: list[int] = []
        done: set[int] = {self.find(self.component[component])} if component in self.component else set()
        num, both, mine = self.num, self.num + self.den, len(tokens)
        stack = [(self.root, 0, -1)]
        while stack:
            node, shared, last = stack.pop()
            self.visits += 1
            # lengths: the sizes below must overlap with what this size allows
            if node.most * self.den < num * size or node.least * num > self.den * size:
                continue
            need = num * (size + max(node.least, -(-num * size // self.den)))
            bound = shared + min(node.long - node.at, mine - 1 - last)
            if both * bound < need:
                continue
            hits = [place[t] for t in node.run if t in place]
            if hits:
                shared, last = shared + len(hits), hits[-1]
            bound = shared + min(node.long - node.at - len(node.run), mine - 1 - last)
            if both * bound < need:
                continue
            for i in node.ends:
                union = size + self.sizes[i] - shared
                if self.den * shared >= num * union and (g := self.find(i)) not in done:
                    done.add(g)
                    found.append(i)
            for kid in node.kids.values():
                if done and self._settled(kid, done):
                    continue
                stack.append((kid, shared, last))
        return found

    def _settled(self, node: _Node, done: set[int]) -> bool:
        """Whether every set below belongs to one group that is already linked."""
        if node.group == -1 or node.group is None:
            return False
        return self.find(node.group) in done

    def freeze(self) -> None:
        """Notes at each node the one group below it, so that probes can pass over what they know."""
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.kids.values())
        for node in reversed(order):
            groups = {self.find(i) for i in node.ends} | {k.group for k in node.kids.values()}
            node.group = groups.pop() if len(groups) == 1 else None

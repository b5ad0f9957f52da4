"""Least edit strings of equal cost, as shared linked nodes.

A string is a node: its last character, its parent, and the ancestors 1, 2, 4 … characters above it. All
strings of a search share their prefixes. Two strings are compared by a search for their longest common
prefix over rolling hashes of the ancestors; what the hashes call equal is walked and verified, and chains
that were found equal are joined (union-find), so no stretch is walked twice. `settle` writes out what all
live strings share and forgets it, so a long run keeps only the stretch that is still open.
"""

from __future__ import annotations

import os

BASE, MODULUS = 1_000_003, (1 << 61) - 1
ROOT = 0


class Paths:
    def __init__(self, modulus: int = MODULUS):
        self.modulus, self.done, self.limit = modulus, [], 4096
        self._clear()

    def _clear(self) -> None:
        self.char, self.depth, self.hash, self.up, self.same = [""], [0], [0], [()], [0]

    def add(self, parent: int, char: str) -> int:
        node, above, hop, k = len(self.char), [parent], parent, 0
        while k < len(self.up[hop]):
            hop = self.up[hop][k]
            above.append(hop)
            k += 1
        self.char.append(char)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(char)) % self.modulus)
        self.up.append(tuple(above))
        self.same.append(node)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        while (high := self.depth[node] - depth) > 0:
            node = self.up[node][high.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _class(self, node: int) -> int:
        while self.same[node] != node:
            self.same[node] = node = self.same[self.same[node]]
        return node

    def _verified(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth are the same string; joins what it has walked."""
        walked = []
        while (x := self._class(a)) != (y := self._class(b)):
            if self.char[a] != self.char[b]:
                return False
            walked.append((x, y))
            a, b = self.up[a][0], self.up[b][0]
        for x, y in walked:
            self.same[self._class(x)] = self._class(y)
        return True

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, depth), self.ancestor(b, depth)
        x, y = a, b
        if self.hash[x] != self.hash[y]:
            for k in reversed(range(len(self.up[x]))):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            x, y = self.up[x][0], self.up[y][0]
        if self._verified(x, y):
            return self.depth[x]
        return len(os.path.commonprefix([self.text(a), self.text(b)]))

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether the string of `a` with the character x comes before that of `b` with y (each "" for none)."""
        n = self.common(a, b)
        s = self.char[self.ancestor(a, n + 1)] if n < self.depth[a] else x
        t = self.char[self.ancestor(b, n + 1)] if n < self.depth[b] else y
        if s != t or not s:
            return s < t
        # One string and its character run into the other: compare what follows.
        return self.text(a) + x < self.text(b) + y

    def settle(self, nodes: list[int | None]) -> list[int | None]:
        """The live nodes, renumbered once many are kept: their common prefix is done, all others are dropped."""
        if len(self.char) < self.limit:
            return nodes
        texts = [None if n is None else self.text(n) for n in nodes]
        live = [t for t in texts if t is not None]
        shared = os.path.commonprefix(live)
        self.done.append(shared)
        self._clear()
        known, out = {}, []
        for t in texts:
            node = None if t is None else ROOT
            for c in t[len(shared):] if t is not None else ():
                if (node, c) not in known:
                    known[node, c] = self.add(node, c)
                node = known[node, c]
            out.append(node)
        self.limit = max(4096, 4 * len(self.char))
        return out

    def whole(self, node: int) -> str:
        return "".join(self.done) + self.text(node)

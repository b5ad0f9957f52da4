"""A BK-tree over 64-bit fingerprints: children are keyed by their distance to the parent."""

from __future__ import annotations


class BKTree:
    """Nodes are numbered in the order in which they come."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children = radius, [], []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        n, new = 0, len(self.values) - 1
        while n != new:
            n = self.children[n].setdefault((value ^ self.values[n]).bit_count(), new)

    def near(self, value: int):
        """Numbers of the nodes within the radius; follows only edges that can lead to one."""
        if not self.values:
            return
        values, children, radius, todo = self.values, self.children, self.radius, [0]
        while todo:
            n = todo.pop()
            d = (value ^ values[n]).bit_count()
            if d <= radius:
                yield n
            for edge, child in children[n].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)


class Links:
    """Joins of classes: those that connect what wasn't connected are kept, at most one per item."""

    def __init__(self, n: int):
        self.parent, self.classes, self.kept = list(range(n)), n, []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.classes -= 1
            self.kept.append((i, j))


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Positions of linked pairs, enough to connect all that the links within the radius connect."""
    tree, links = BKTree(radius), Links(len(values))
    for i, value in enumerate(values):
        for n in tree.near(value):
            links.join(i, n)
            if links.classes == len(values) - i:  # all so far are connected, nothing more to learn
                break
        tree.add(value)
    return links.kept


def links_between(left: list[int], right: list[int], radius: int) -> list[tuple[int, int]]:
    """The same for links from `right` to `left` alone, for two shards of one group."""
    tree, links = BKTree(radius), Links(len(left) + len(right))
    for value in left:
        tree.add(value)
    for i, value in enumerate(right, start=len(left)):
        for n in tree.near(value):
            links.join(i, n)
    return [(n, i - len(left)) for i, n in links.kept]

"""A Patricia trie over byte strings: each edge holds as many bytes as its keys share."""

from __future__ import annotations

from collections.abc import Iterator


class Node:
    __slots__ = ("label", "kids", "value")

    def __init__(self, label: bytes):
        self.label = label
        self.kids: dict[int, Node] = {}
        self.value = None


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` shares with ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """``at(key)`` gives the node that ends ``key``; ``size`` estimates the bytes held."""

    NODE_BYTES = 250

    def __init__(self):
        self.root = Node(b"")
        self.size = 0

    def at(self, key: bytes) -> Node:
        node, at, end = self.root, 0, len(key)
        while at < end:
            child = node.kids.get(key[at])
            if child is None:
                child = node.kids[key[at]] = Node(key[at:])
                self.size += end - at + self.NODE_BYTES
                return child
            if not key.startswith(child.label, at):
                cut = shared(child.label, key, at)
                fork = Node(child.label[:cut])
                child.label = child.label[cut:]
                fork.kids[child.label[0]] = child
                node.kids[key[at]] = child = fork
                self.size += self.NODE_BYTES
            at += len(child.label)
            node = child
        return node

    def branch_point(self) -> tuple[bytes, Node]:
        """The node below which the keys first differ, and the bytes that lead to it."""
        path, node = b"", self.root
        while len(node.kids) == 1 and node.value is None:
            (node,) = node.kids.values()
            path += node.label
        return path, node

    def detach_largest(self) -> tuple[bytes, list[tuple[bytes, object]]]:
        """Take the heaviest subtree below the first branching out of the trie; returns its path and entries."""
        path, top = self.branch_point()
        if not top.kids:
            return path, []
        byte, weight = max(((first, weight_of(child)) for first, child in top.kids.items()), key=lambda x: x[1])
        child = top.kids.pop(byte)
        self.size = max(0, self.size - weight)
        return path + bytes([byte]), list(walk(child, path))

    def entries(self) -> Iterator[tuple[bytes, object]]:
        return walk(self.root, b"")


def weight_of(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        total += len(x.label) + Patricia.NODE_BYTES
        todo.extend(x.kids.values())
    return total


def walk(node: Node, path: bytes) -> Iterator[tuple[bytes, object]]:
    todo = [(node, path + node.label)]
    while todo:
        x, key = todo.pop()
        if x.value is not None:
            yield key, x.value
        todo.extend((kid, key + kid.label) for kid in x.kids.values())

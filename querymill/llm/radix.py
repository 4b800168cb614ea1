"""An adaptive radix tree over keys of fixed-width ids, with what the prefixes of whole ids hold.

A node knows its children by their next byte, in one of four layouts that grow as children come: up to 4 or 16 listed beside their bytes, up to 48 behind an index of
256 bytes, or 256 places. Bytes without a branch are kept as the path of one node. Nodes lie at any byte depth; only depths that are whole numbers of ids
are reported.
"""

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

WIDTH = 16  # bytes of an id


class Listed:
    """Up to 4 or 16 children beside their bytes, in order."""

    def __init__(self, room: int):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node) -> "Listed | Indexed":
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) < self.room:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
            return self
        return _moved(self, Listed(16) if self.room == 4 else Indexed()).put(byte, node)

    def items(self) -> Iterator:
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children, found through a place for every byte."""

    def __init__(self):
        self.places, self.nodes = bytearray(256), []  # 0: no child

    def get(self, byte: int):
        return self.nodes[self.places[byte] - 1] if self.places[byte] else None

    def put(self, byte: int, node) -> "Indexed | Full":
        if self.places[byte]:
            self.nodes[self.places[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            return _moved(self, Full()).put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator:
        return ((b, self.nodes[p - 1]) for b, p in enumerate(self.places) if p)


class Full:
    """A place for a child of every byte."""

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> "Full":
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


def _moved(old, new):
    for byte, node in old.items():
        new.put(byte, node)
    return new


class Node:
    __slots__ = ("path", "children", "ends")

    def __init__(self, path: bytes):
        self.path, self.children, self.ends = path, Listed(4), []

    def hang(self, node: "Node") -> None:
        self.children = self.children.put(node.path[0], node)


# A prefix of ``depth`` ids; ``parent`` is the smallest member of the prefix before it, or, where ``slot`` names that one of the spine, not known yet.
ROW = ["conv_id", "depth", "parent_conv_id", "slot", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Spine(NamedTuple):
    """What is known here of a prefix of the first or last key, which other trees may hold too; ``children``, ``leaves`` and ``saved`` are of its other branches."""

    slot: int
    name: bytes
    above: bytes | None
    least: int
    depth: int
    members: int
    words: int
    children: int
    leaves: int
    saved: int
    ends: list[int]


class Summary:
    """Of a subtree: members, the smallest of them, topmost rows that wait for their parent, and the sums of all rows."""

    __slots__ = ("members", "least", "waiting", "leaves", "saved")

    def __init__(self):
        self.members, self.least, self.waiting, self.leaves, self.saved = 0, None, [], 0, 0

    def add(self, other: "Summary") -> None:
        self.members += other.members
        self.least = other.least if self.least is None else min(self.least, other.least)
        if len(self.waiting) < len(other.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting
        self.leaves += other.leaves
        self.saved += other.saved


def common(a: bytes, b: bytes) -> int:
    """Bytes that both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


class Tree:
    """Keys with a number each, inserted in ascending order of keys and numbers."""

    def __init__(self):
        self.root, self.first, self.last, self.words, self.ids = Node(b""), None, b"", {}, 0

    def insert(self, key: bytes, number: int, words: list[int]) -> None:
        """``words[i]`` belongs to the i-th id of the key, and is the same wherever that id stands."""
        self.first, self.last = key if self.first is None else self.first, key
        self.ids += len(key) // WIDTH + 1
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.hang(child)
                for i in range(at // WIDTH, len(key) // WIDTH):
                    self.words[key[i * WIDTH:(i + 1) * WIDTH]] = words[i]
                node, at = child, len(key)
                break
            shared = len(child.path) if key.startswith(child.path, at) else common(child.path, key[at:at + len(child.path)])
            if shared < len(child.path):
                middle = Node(child.path[:shared])
                child.path = child.path[shared:]
                middle.hang(child)
                node.hang(middle)
                child = middle
            node, at = child, at + shared
        node.ends.append(number)

    def report(self) -> tuple[list[list], list[Spine]]:
        """All prefixes: those of the first and the last key, and the rows of all others."""
        self.rows, self.spine = [], []
        self.left, self.right = _names(self.first), _names(self.last)
        # A frame: node, its path from the root, what is found below it so far, and the children still to visit.
        frames = [(self.root, b"", Summary(), self.root.children.items())]
        while True:
            node, path, below, children = frames[-1]
            step = next(children, None)
            if step is not None:
                child = step[1]
                frames.append((child, path + child.path, Summary(), child.children.items()))
                continue
            frames.pop()
            if node.ends:
                below.members += len(node.ends)
                below.least = node.ends[0] if below.least is None else min(below.least, node.ends[0])
            lowest = (len(path) - len(node.path)) // WIDTH if frames else -1
            on_left, on_right = (common(path, key) // WIDTH for key in (self.first, self.last))
            for depth in range(len(path) // WIDTH, lowest, -1):
                ends = node.ends if depth * WIDTH == len(path) else []
                at = (depth, self.left) if depth <= on_left else (len(self.left) + depth, self.right) if depth <= on_right else None
                below = self._prefix(path, depth, below, ends, at)
            if not frames:
                return self.rows, self.spine
            frames[-1][2].add(below)

    def _prefix(self, path: bytes, depth: int, below: Summary, ends: list[int], at: tuple[int, list[bytes]] | None) -> Summary:
        """Report a prefix, and tell the rows below it their parent. ``at``: its slot and names, if it is on the spine."""
        words = self.words[path[(depth - 1) * WIDTH:depth * WIDTH]] if depth else 0
        out = Summary()
        out.members, out.least = below.members, below.least
        if at:
            slot, names = at
            for row in below.waiting:
                row[3] = slot
            above = names[depth - 1] if depth else None
            self.spine.append(Spine(slot, names[depth], above, below.least, depth, below.members, words, len(below.waiting), below.leaves, below.saved, ends))
            return out
        for row in below.waiting:
            row[2] = below.least
        out.leaves, out.saved = below.leaves or 1, below.saved + (below.members - 1) * words
        row = [below.least, depth, None, None, below.members, len(below.waiting), out.leaves, out.saved, digest(ends)]
        self.rows.append(row)
        out.waiting = [row]
        return out


def _names(key: bytes) -> list[bytes]:
    """A name for each prefix, made from that of the one before it."""
    names = [b""]
    for i in range(0, len(key), WIDTH):
        names.append(hashlib.md5(names[-1] + key[i:i + WIDTH]).digest())
    return names

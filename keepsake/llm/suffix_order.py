"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

SHALLOW = 16
STEP = 8  # bytes compared at a time by the quicksort


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps at each node only a depth and the branching bytes; the strings themselves stay outside."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # [depth, {byte or -1: node}] or, for a leaf, [None, numbers of equal strings]

    def _branch(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = [None, [number]]
            return
        node = self.root
        while node[0] is not None:  # blind: only branching bytes are looked at
            node = node[1].get(self._branch(s, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(number)
            return
        shared = common_prefix(s, other)
        parent, node = None, self.root
        while node[0] is not None and node[0] < shared:
            parent, node = node, node[1][self._branch(s, node[0])]
        if node[0] == shared:
            node[1][self._branch(s, shared)] = [None, [number]]
            return
        split = [shared, {self._branch(other, shared): node, self._branch(s, shared): [None, [number]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][self._branch(s, parent[0])] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings' numbers in order, and each one's common prefix with the one before (-1 for the first)."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, -1)] if self.root is not None else []
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                order.extend(node[1])
                shared.append(before)
                shared.extend([len(self.strings[node[1][0]])] * (len(node[1]) - 1))
                continue
            keys = sorted(node[1])
            for k in reversed(keys):
                stack.append((node[1][k], before if k == keys[0] else node[0]))
        return order, shared


def deep_shallow(strings: list[bytes], depth: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Numbers of the strings in order, and the common prefix of each with the one before it (-1 for the first).

    The quicksort parts a list by the next bytes of a pivot, three ways; lists that still tie at ``depth`` are
    ordered by a blind trie.
    """
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        numbers, at = stack.pop()
        if not numbers:
            continue
        if len(numbers) == 1:
            some, lcp = numbers, [-1]
        elif at >= depth:
            trie = BlindTrie(strings)
            for k in numbers:
                trie.insert(k)
            some, lcp = trie.ordered()
        else:
            pivot = strings[numbers[len(numbers) // 2]][at:at + STEP]
            less, same, more = [], [], []
            for k in numbers:
                piece = strings[k][at:at + STEP]
                (same if piece == pivot else less if piece < pivot else more).append(k)
            stack.append((more, at))
            stack.append((same, at + STEP if len(pivot) == STEP else depth))
            stack.append((less, at))
            continue
        lcp[0] = common_prefix(strings[order[-1]], strings[some[0]]) if order else -1
        order.extend(some)
        shared.extend(lcp)
    return order, shared

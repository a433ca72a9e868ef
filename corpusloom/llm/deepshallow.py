"""Deep-shallow suffix sorting of the windows of several byte strings.

Shallow: multikey quicksort with characters of eight bytes, down to ``SHALLOW``
characters; small parts are sorted at once on what is left of that depth.
Deep: what still agrees there has a long common prefix, and is ordered by a
blind trie: an insertion walks down looking only at branching bytes, compares
once with the leaf it meets, and goes to where the two first differ.
"""

from __future__ import annotations

import numpy as np

CHARACTER, SHALLOW, SMALL = 8, 2, 64


class BlindTrie:
    """Order of byte strings of one length by their first difference."""

    def __init__(self, width: int):
        self.width, self.root = width, None

    def insert(self, text: bytes, name: int) -> None:
        if self.root is None:
            self.root = [text, [name]]
            return
        # Walk without comparing: a missing branch is replaced by any.
        node = self.root
        while len(node) == 3:
            node = node[2].get(text[node[0]]) or next(iter(node[2].values()))
        differ = int.from_bytes(text, "big") ^ int.from_bytes(node[0], "big")
        if not differ:
            node[1].append(name)
            return
        common = (8 * self.width - differ.bit_length()) // 8
        other = node[0][common]
        above, node = None, self.root
        while len(node) == 3 and node[0] < common:
            above, node = (node, text[node[0]]), node[2][text[node[0]]]
        leaf = [text, [name]]
        if len(node) == 3 and node[0] == common:
            node[2][text[common]] = leaf
            return
        branch = [common, None, {other: node, text[common]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[0][2][above[1]] = branch

    def classes(self) -> list[list[int]]:
        """Names in order, those of equal strings together."""
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                out.append(node[1])
            else:
                stack += [node[2][b] for b in sorted(node[2], reverse=True)]
        return out


def _character(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(CHARACTER):
        out = (out << np.uint64(8)) | data[starts + k]
    return out


def _shallow(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Groups of ``starts`` that agree in SHALLOW characters, in order."""
    groups: list[np.ndarray] = []
    stack = [(starts, 0)]
    while stack:
        part, depth = stack.pop()
        if depth == SHALLOW or len(part) < 2:
            groups.append(part)
            continue
        if len(part) <= SMALL:
            keys = [_character(data, part + CHARACTER * d) for d in range(depth, SHALLOW)]
            order = np.lexsort(keys[::-1])
            fresh = np.zeros(len(part), bool)
            for k in keys:
                k = k[order]
                fresh[1:] |= k[1:] != k[:-1]
            groups += np.split(part[order], np.flatnonzero(fresh))
            continue
        key = _character(data, part + CHARACTER * depth)
        pivot = np.sort(key[:: max(1, len(key) // 64)])
        pivot = pivot[len(pivot) // 2]
        stack += [(part[key > pivot], depth), (part[key == pivot], depth + 1), (part[key < pivot], depth)]
        stack = [s for s in stack if len(s[0])]
    return groups


def sorted_classes(data: bytes, starts: np.ndarray, width: int) -> list[list[int]]:
    """Window starts in the order of their ``width`` bytes, equal windows together."""
    if width < CHARACTER * SHALLOW:
        trie = BlindTrie(width)
        for s in starts.tolist():
            trie.insert(data[s : s + width], s)
        return trie.classes()
    out: list[list[int]] = []
    for group in _shallow(np.frombuffer(data, np.uint8).astype(np.uint64), starts):
        names = group.tolist()
        if len(names) == 1:
            out.append(names)
        elif len(names) == 2:  # a trie of one leaf
            a, b = data[names[0] : names[0] + width], data[names[1] : names[1] + width]
            out += [names] if a == b else [[names[0]], [names[1]]] if a < b else [[names[1]], [names[0]]]
        else:
            trie = BlindTrie(width)
            for s in names:
                trie.insert(data[s : s + width], s)
            out += trie.classes()
    return out

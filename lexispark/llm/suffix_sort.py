"""Deep-shallow sorting of suffixes that are given as byte strings of bounded length."""

from __future__ import annotations

import numpy as np

#: Characters of eight bytes that the shallow sort looks at.
SHALLOW = 6


class BlindTrie:
    """A trie of distinct strings that keeps branching places only, for strings with long common prefixes.

    A search reads one byte per branching place and may end at a wrong leaf; one
    comparison with that leaf's string shows where the new string really
    branches off.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = 0  # a leaf is the number of its string, a node is [place, {byte: child}]
        for i in range(1, len(strings)):
            self._insert(i)

    def _byte(self, i: int, place: int) -> int:
        s = self.strings[i]
        return s[place] if place < len(s) else -1

    def _insert(self, i: int) -> None:
        at = self.root
        while isinstance(at, list):
            at = at[1].get(self._byte(i, at[0])) if self._byte(i, at[0]) in at[1] else next(iter(at[1].values()))
        place = _common(self.strings[i], self.strings[at])
        parent, at = None, self.root
        while isinstance(at, list) and at[0] < place:
            parent, at = at, at[1][self._byte(i, at[0])]
        if isinstance(at, list) and at[0] == place:
            at[1][self._byte(i, place)] = i
            return
        sample = at
        while isinstance(sample, list):
            sample = next(iter(sample[1].values()))
        node = [place, {self._byte(sample, place): at, self._byte(i, place): i}]
        if parent is None:
            self.root = node
        else:
            parent[1][self._byte(i, parent[0])] = node

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            at = stack.pop()
            if isinstance(at, list):
                stack.extend(at[1][b] for b in sorted(at[1], reverse=True))
            else:
                out.append(at)
        return out


def _common(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def deep_shallow(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows of a byte matrix, and how many bytes each has in common with the one before.

    Shallow: a multikey sort with characters of eight bytes. A round sorts the
    runs of rows that are still equal by their next character; runs of one row
    drop out. Deep: runs that are equal in all shallow characters have long
    common prefixes; a blind trie orders the distinct ones among them.
    """
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    chars = padded.view(">u8").astype(np.uint64)
    order = np.arange(n)
    run = np.zeros(n, np.int64)  # of each place in the order
    for depth in range(min(SHALLOW, chars.shape[1])):
        tied = _tied(run)
        if not len(tied):
            break
        key = chars[order[tied], depth]
        by = np.lexsort((key, run[tied]))
        order[tied] = order[tied][by]
        key = key[by]
        first = np.zeros(n, bool)
        first[0] = True
        first[1:] = run[1:] != run[:-1]
        new = np.append(False, (key[1:] != key[:-1]) & (np.diff(tied) == 1))
        first[tied[new]] = True
        run = np.cumsum(first)
    _deep(order, run, padded)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = chars[order[:-1]], chars[order[1:]]
        differs = a != b
        which = np.where(differs.any(1), differs.argmax(1), chars.shape[1])
        inside = np.minimum(which, chars.shape[1] - 1)
        rows = np.arange(n - 1)
        x = a[rows, inside] ^ b[rows, inside]
        same = np.zeros(n - 1, np.int64)
        for k in range(1, 8):
            same += (x >> np.uint64(64 - 8 * k)) == 0
        lcp[1:] = np.minimum(np.where(which < chars.shape[1], which * 8 + same, width), width)
    return order, lcp


def _tied(run: np.ndarray) -> np.ndarray:
    same = run[1:] == run[:-1]
    return np.flatnonzero(np.append(False, same) | np.append(same, False))


def _deep(order: np.ndarray, run: np.ndarray, padded: np.ndarray) -> None:
    tied = _tied(run)
    if not len(tied):
        return
    starts = np.flatnonzero(np.append(True, np.diff(run[tied]) != 0))
    tails = padded[:, SHALLOW * 8 :]
    for a, b in zip(starts, np.append(starts[1:], len(tied)), strict=True):
        places = tied[a:b]
        rows = order[places]
        keys = [tails[r].tobytes() for r in rows]
        distinct = list(dict.fromkeys(keys))
        if len(distinct) == 1:
            continue
        trie = BlindTrie(distinct)
        rank = {distinct[i]: k for k, i in enumerate(trie.order())}
        order[places] = rows[np.argsort([rank[k] for k in keys], kind="stable")]

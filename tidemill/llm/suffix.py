"""Deep-shallow sorting of many short strings, held as rows of big-endian 64-bit words.

Shallow part: a multikey quicksort by words. All segments of a round are partitioned at once, each
about its own pivot; what equals the pivot moves on to the next word, until SHALLOW words are used.
Deep part: a group that still shares its prefix is ordered by a blind trie, which keeps only the
places where strings branch and reads a whole string once, to learn where it leaves the trie.
"""

from __future__ import annotations

import numpy as np

#: Words compared by the multikey quicksort before blind tries take over.
SHALLOW = 4


def as_words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes (a multiple of eight wide) as big-endian words: numeric order is byte order."""
    return np.ascontiguousarray(rows).view(">u8").astype(np.uint64)


def _partition(words: np.ndarray, order: np.ndarray, depth: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: every segment (begin, length) of order about a pivot of its own; the new segments."""
    seg = np.repeat(np.arange(len(begin)), length)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
    rows = order[at]
    value = words[rows, depth[seg]]
    first = np.cumsum(length) - length
    picks = np.stack([value[first], value[first + length // 2], value[first + length - 1]])
    pivot = np.sort(picks, axis=0)[1][seg]
    side = (value > pivot).astype(np.int8) + (value >= pivot)  # 0 less, 1 equal, 2 greater
    fresh = np.lexsort((side, seg)) if len(seg) < 64 else np.argsort(seg * 3 + side, kind="stable")
    order[at] = rows[fresh]
    counts = np.bincount(seg * 3 + side, minlength=3 * len(begin)).reshape(-1, 3)
    begins = begin[:, None] + np.cumsum(counts, axis=1) - counts
    deeper = depth[:, None] + np.array([0, 1, 0])
    keep = counts > 1
    return begins[keep], counts[keep], deeper[keep]


class BlindTrie:
    """Strings of one length by the places where they branch. Nodes: (place, {byte: node}); leaves: string numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: object = 0
        self.same: dict[int, int] = {}

    def add(self, k: int) -> None:
        s, node, path = self.strings[k], self.root, []
        while isinstance(node, tuple):
            path.append(node)
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        t = self.strings[node]
        if s == t:
            self.same[k] = node
            return
        low, high = 0, len(s)
        while high - low > 1:  # the common prefix, by halves
            mid = (low + high) // 2
            low, high = (mid, high) if s[low:mid] == t[low:mid] else (low, mid)
        place = low if s[low] != t[low] else high
        parent = None
        for n in path:
            if n[0] >= place:
                break
            parent = n
        if parent is None:
            below = self.root
        else:
            below = parent[1].get(s[parent[0]])
        if isinstance(below, tuple) and below[0] == place:
            below[1][s[place]] = k
            return
        made = (place, {t[place]: below, s[place]: k})
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]]] = made

    def ordered(self) -> list[int]:
        """String numbers in byte order, one of each set of equal strings."""
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def deep_shallow(words: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows, and for each place in it the number of its class of equal rows."""
    n, width = words.shape
    order = np.arange(n)
    head = np.zeros(n, bool)  # where a class begins
    if n:
        head[0] = True
    begin, length, depth = np.array([0]), np.array([n]), np.array([0])
    begin, length, depth = begin[length > 1], length[length > 1], depth[length > 1]
    stop = min(shallow, width)
    deep_begin, deep_length = [], []
    while len(begin):
        begin, length, depth = _partition(words, order, depth, begin, length)
        done = depth >= stop
        deep_begin.append(begin[done])
        deep_length.append(length[done])
        begin, length, depth = begin[~done], length[~done], depth[~done]
    prefix = words[order][:, :stop]
    head[1:] |= (prefix[1:] != prefix[:-1]).any(axis=1)
    if width > stop and deep_begin:
        _deep(words, order, head, np.concatenate(deep_begin), np.concatenate(deep_length), stop)
    return order, np.cumsum(head) - 1


def _deep(words: np.ndarray, order: np.ndarray, head: np.ndarray, begin: np.ndarray, length: np.ndarray, stop: int) -> None:
    """Orders groups that share their first words. Rows that equal the first of their group go together
    at once; the others, with that first one, go through a blind trie."""
    seg = np.repeat(np.arange(len(begin)), length)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(begin, length)
    rows = order[at]
    tail = words[:, stop:]
    differs = (tail[rows] != tail[order[begin]][seg]).any(axis=1)
    odd = np.flatnonzero(differs)
    if not len(odd):
        return
    # The first row of each group that differs from the group's first; most groups have no third string,
    # and the trie of two is a single branch, which is found for all of them at once.
    lead = odd[np.concatenate([[True], seg[odd][1:] != seg[odd][:-1]])]
    second = np.full(len(begin), -1)
    second[seg[lead]] = rows[lead]
    third = np.zeros(len(begin), bool)
    third[seg[odd[(tail[rows[odd]] != tail[second[seg[odd]]]).any(axis=1)]]] = True
    two = (second >= 0) & ~third
    if two.any():
        one, other = tail[order[begin[two]]], tail[second[two]]
        branch = (one != other).argmax(axis=1)
        line = np.arange(len(branch))
        rises = np.zeros(len(begin), bool)
        rises[two] = one[line, branch] < other[line, branch]
        mine = np.flatnonzero(two[seg])
        late = differs[mine] == rises[seg[mine]]
        order[at[mine]] = rows[mine][np.argsort(seg[mine] * 2 + late, kind="stable")]
        head[begin[two] + np.bincount(seg[mine], ~late, minlength=len(begin)).astype(np.int64)[two]] = True
    mixed = np.flatnonzero(third)
    first = np.cumsum(length) - length
    wide = 8 * tail.shape[1]
    for k in mixed.tolist():
        a, b = int(first[k]), int(first[k] + length[k])
        own, off = rows[a:b], differs[a:b]
        odd_rows = own[off].tolist()
        data = tail[[own[0], *odd_rows]].astype(">u8").tobytes()
        same: dict[bytes, list[int]] = {data[:wide]: own[~off].tolist()}
        for j, r in enumerate(odd_rows, 1):
            same.setdefault(data[j * wide : (j + 1) * wide], []).append(r)
        strings = list(same)
        trie = BlindTrie(strings)
        for j in range(1, len(strings)):
            trie.add(j)
        place = int(begin[k])
        for j in trie.ordered():
            members = same[strings[j]]
            order[place : place + len(members)] = members
            head[place] = True
            place += len(members)

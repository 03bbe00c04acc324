"""Deep-shallow ordering of strings: multikey quicksort first, blind tries for what still ties."""

from __future__ import annotations

SHALLOW = 24


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving on slices that compare in C."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie_order(strings: list[bytes], items: list[int]) -> list[int]:
    """items in the order of their strings, by insertion into a blind trie.

    An inner node keeps only the depth at which its children differ. A search follows the branching
    bytes without looking at those between, ends at some leaf, and one comparison with that leaf
    finds the depth at which the new string leaves the path; there it is inserted.
    """
    # a node is [depth, {byte: child}]; a leaf is the list of items with the same string
    root: list = [items[0]]
    leaf = lambda node: isinstance(node[-1], int)
    for item in items[1:]:
        s, node = strings[item], root
        while not leaf(node):
            children = node[1]
            node = children.get(_at(s, node[0])) or next(iter(children.values()))
        other = strings[node[0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node.append(item)
            continue
        parent, edge, node = None, None, root
        while not leaf(node) and node[0] < depth:
            parent, edge = node, _at(s, node[0])
            node = node[1][edge]
        if not leaf(node) and node[0] == depth:
            node[1][_at(s, depth)] = [item]
            continue
        inner = [depth, {_at(other, depth): node, _at(s, depth): [item]}]
        if parent is None:
            root = inner
        else:
            parent[1][edge] = inner
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if leaf(node):
            out += node
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices in the order of the strings, equal strings in index order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out += items
            continue
        if depth >= shallow:
            out += blind_trie_order(strings, items)
            continue
        pivot = _at(strings[items[len(items) // 2]], depth)
        less, same, more = [], [], []
        for i in items:
            b = _at(strings[i], depth)
            (less if b < pivot else same if b == pivot else more).append(i)
        stack.append((more, depth))
        if pivot < 0:  # all of these have ended: they are equal
            stack += [([i], depth) for i in reversed(same)]
        else:
            stack.append((same, depth + 1))
        stack.append((less, depth))
    return out


def order_and_prefixes(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Indices in the order of the strings, and at each place the prefix shared with the string before (0 at the first)."""
    order = deep_shallow_order(strings)
    return order, [0, *(common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:]))][: len(order)]


def neighbour_prefixes(strings: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with any other."""
    best = [0] * len(strings)
    order, shared = order_and_prefixes(strings)
    for k in range(1, len(order)):
        for i in (order[k - 1], order[k]):
            best[i] = max(best[i], shared[k])
    return best

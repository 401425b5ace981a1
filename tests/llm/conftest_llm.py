"""Helpers of the tests in this folder."""

from __future__ import annotations

WORDS = "the quick brown fox jumps over a lazy dog while seven old wizards quietly mix strange potions under pale moonlight near silent rivers".split()


def sentence(seed: int, n: int) -> str:
    """Different for each seed, the same in every run."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + chr(97 + (x >> 16) % 26) + chr(97 + (x >> 21) % 26))
    return " ".join(out)


def components_of(nodes, edges):
    """The smallest node that each reaches."""
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root

"""K-way merging with a tree of losers: one comparison per level for each row that leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any


def merge(runs: list[Iterable[tuple]], key: Callable[[tuple], Any] = lambda row: row) -> Iterator[tuple]:
    """Merge sorted runs. Equal keys leave in the order of their runs."""
    sources = [iter(r) for r in runs]
    k = len(sources)
    rows: list[tuple | None] = [next(s, None) for s in sources]
    keys = [None if r is None else key(r) for r in rows]

    def ahead(a: int, b: int) -> bool:
        if rows[a] is None or rows[b] is None:
            return rows[a] is not None
        return (keys[a], a) < (keys[b], b)

    losers = [-1] * max(k, 1)
    if not k:
        return

    def first(node: int) -> int:
        """Play the matches below ``node``; leaves are k .. 2k-1."""
        if node >= k:
            return node - k
        a, b = first(2 * node), first(2 * node + 1)
        winner, losers[node] = (a, b) if ahead(a, b) else (b, a)
        return winner

    top = first(1) if k > 1 else 0
    while rows[top] is not None:
        yield rows[top]
        rows[top] = next(sources[top], None)
        keys[top] = None if rows[top] is None else key(rows[top])
        node = (top + k) // 2
        while node:
            if ahead(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least ``start``."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    while True:
        step = 64
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            m = min(len(x), len(y))
            d = int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])
            return start + (m if not d else m - (d.bit_length() + 7) // 8)
        start += step


def merge_prefixed(runs: list[list[tuple[int, bytes, Any]]]) -> Iterator[tuple[int, bytes, Any]]:
    """Merge runs of (common prefix with the row before, string, payload), each sorted by string.

    Every loser keeps its common prefix with the string that beat it last. Two candidates whose
    prefixes with the last row out differ are ordered by those lengths alone; only at equal lengths are bytes
    compared, and from that length on. Yields (common prefix with the row before, string, payload).
    """
    k = len(runs)
    at = [0] * k
    # lcp[i]: common prefix of run i's head and the last string that left
    lcp = [0] * k
    live = [bool(r) for r in runs]
    head = [r[0][1] if r else b"" for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's lcp becomes that with the winner."""
        if not live[a] or not live[b]:
            return (a, b) if live[a] else (b, a)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        n = common(head[a], head[b], lcp[a])
        x, y = head[a][n : n + 1], head[b][n : n + 1]
        w, z = (a, b) if (x, a) <= (y, b) else (b, a)
        lcp[z] = n
        return w, z

    losers = [0] * max(k, 1)
    if not k:
        return

    def first(node: int) -> int:
        if node >= k:
            return node - k
        w, losers[node] = play(first(2 * node), first(2 * node + 1))
        return w

    top = first(1) if k > 1 else 0
    while live[top]:
        run, i = runs[top], at[top]
        yield lcp[top], run[i][1], run[i][2]
        at[top] = i = i + 1
        if i < len(run):
            lcp[top], head[top] = run[i][0], run[i][1]
        else:
            live[top] = False
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2

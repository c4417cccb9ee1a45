"""Minimum cut of a small graph between two terminals."""

from __future__ import annotations

from collections import deque


def source_side(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes lie with the source in a minimum cut.

    ``gain`` is a node's capacity from the source if positive, else to the sink. ``edges`` are
    (node, node, capacity both ways). Shortest augmenting paths by levels; of several minimum cuts
    the one with the smallest source side.
    """
    n = len(gain)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, forth: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(forth)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0)
        elif g < 0:
            join(i, sink, -g, 0)
    for a, b, c in edges:
        join(a, b, c, c)

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                # Back to the tail of the first full edge.
                cut = next(i for i, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]
                at[a] += 1

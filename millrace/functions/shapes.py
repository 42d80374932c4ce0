"""Kernels over the points, items or sets of one row or group; wrap them with ``kernels.apply`` or ``applyInPandas``."""

from __future__ import annotations

import heapq
import math
from itertools import combinations

from millrace.operators.lookup import hull_of

Point = tuple[float, float]


def turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def simplify(points: list[Point], tolerance: float) -> list[Point]:
    """Points of a line that stay within a tolerance (farthest points are kept, without recursion)."""
    if len(points) < 3:
        return list(points)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        (x1, y1), (x2, y2) = points[i], points[j]
        length = math.hypot(x2 - x1, y2 - y1)
        away = [(abs(turn(points[i], points[j], points[k])) / length if length else math.dist(points[i], points[k]), k) for k in range(i + 1, j)]
        if away and (far := max(away, key=lambda x: (x[0], -x[1])))[0] > tolerance:
            keep.add(far[1])
            todo += [(i, far[1]), (far[1], j)]
    return [points[k] for k in sorted(keep)]


def diameter(points: list[Point]) -> float:
    """The greatest distance; only hull points can have it."""
    hull = hull_of(points)
    return max((math.dist(a, b) for a, b in combinations(hull, 2)), default=0.0)


def least_rectangle(points: list[Point]) -> float:
    """Area of the smallest rectangle around all points: one of its sides lies on the hull."""
    hull = hull_of(points)
    if len(hull) < 3:
        return 0.0
    best = math.inf
    for (x1, y1), (x2, y2) in zip(hull, hull[1:] + hull[:1]):
        n = math.hypot(x2 - x1, y2 - y1)
        u, v = (x2 - x1) / n, (y2 - y1) / n
        a, b = [x * u + y * v for x, y in hull], [y * u - x * v for x, y in hull]
        best = min(best, (max(a) - min(a)) * (max(b) - min(b)))
    return best


def ear_clip(polygon: list[Point]) -> list[tuple[int, int, int]]:
    """Triangles (places in the polygon) that fill a simple polygon."""
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(polygon, polygon[1:] + polygon[:1]))
    left = list(range(len(polygon))) if area > 0 else list(range(len(polygon)))[::-1]
    out = []
    while len(left) > 3:
        for k, i in enumerate(left):
            h, j = left[k - 1], left[(k + 1) % len(left)]
            a, b, c = polygon[h], polygon[i], polygon[j]
            if turn(a, b, c) > 0 and not any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for m in left if m not in (h, i, j) for p in (polygon[m],)):
                out.append((h, i, j))
                left.pop(k)
                break
        else:
            break
    return out + [tuple(left)]


def delaunay(points: list[Point]) -> list[tuple[int, int, int]]:
    """Triangles of the Delaunay triangulation, points put in one by one; for small groups."""
    n = len(points)
    span = 1e3 * (1 + max((abs(v) for p in points for v in p), default=0.0))
    at = [*points, (-3 * span, -span), (3 * span, -span), (0.0, 3 * span)]

    def inside(t, p):
        (ax, ay), (bx, by), (cx, cy) = ((at[i][0] - p[0], at[i][1] - p[1]) for i in t)
        det = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        return det > 0

    def facing(t):
        return t if turn(*(at[i] for i in t)) > 0 else (t[0], t[2], t[1])

    triangles = {facing((n, n + 1, n + 2))}
    for i in range(n):
        bad = {t for t in triangles if inside(t, at[i])}
        edges = [e for t in bad for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
        rim = [e for e in edges if (e[1], e[0]) not in edges]
        triangles = (triangles - bad) | {facing((a, b, i)) for a, b in rim if turn(at[a], at[b], at[i]) != 0}
    return sorted(tuple(sorted(t)) for t in triangles if max(t) < n)


def voronoi_vertices(points: list[Point]) -> list[Point]:
    """Corners of the Voronoi cells: centres of the Delaunay triangles' circles."""
    out = []
    for t in delaunay(points):
        (ax, ay), (bx, by), (cx, cy) = (points[i] for i in t)
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        q = [x * x + y * y for x, y in ((ax, ay), (bx, by), (cx, cy))]
        out.append(((q[0] * (by - cy) + q[1] * (cy - ay) + q[2] * (ay - by)) / d, (q[0] * (cx - bx) + q[1] * (ax - cx) + q[2] * (bx - ax)) / d))
    return out


def nearest_tour(points: list[Point]) -> list[int]:
    """A tour from place 0, always on to the nearest place left."""
    tour, left = [0], set(range(1, len(points)))
    while left:
        tour.append(min(left, key=lambda j: (math.dist(points[tour[-1]], points[j]), j)))
        left.discard(tour[-1])
    return tour


def tree_tour(points: list[Point]) -> list[int]:
    """A tour at most twice the shortest: a walk around a minimum spanning tree."""
    near, kids, todo = {j: (math.dist(points[0], points[j]), 0) for j in range(1, len(points))}, {i: [] for i in range(len(points))}, [0]
    while near:
        j = min(near, key=lambda j: (near[j][0], j))
        kids[near.pop(j)[1]].append(j)
        for k in near:
            near[k] = min(near[k], (math.dist(points[j], points[k]), j))
    tour = []
    while todo:
        tour.append(i := todo.pop())
        todo += sorted(kids[i], reverse=True)
    return tour


def tour_length(points: list[Point], tour: list[int]) -> float:
    return sum(math.dist(points[a], points[b]) for a, b in zip(tour, tour[1:] + tour[:1]))


def greedy_cover(universe: set, sets: list[set]) -> list[int]:
    """Sets that cover the universe, each time the one with most that is new; the first on a tie."""
    left, out = set(universe), []
    while left:
        k = max(range(len(sets)), key=lambda k: (len(sets[k] & left), -k))
        if not sets[k] & left:
            raise ValueError("no cover")
        out.append(k)
        left -= sets[k]
    return out


def vertex_cover(edges: list[tuple]) -> set:
    """Both ends of edges that have none yet: at most twice the least."""
    out: set = set()
    for a, b in edges:
        if a not in out and b not in out:
            out |= {a, b}
    return out


def exact_cover(rows: list[set], universe: set) -> list[list[int]]:
    """All choices of rows that hold every item once; the item with fewest rows is settled first."""
    if not universe:
        return [[]]
    item = min(universe, key=lambda u: (sum(u in r for r in rows), repr(u)))
    return [[k, *rest] for k, r in enumerate(rows) if item in r and r <= universe for rest in exact_cover([s if not s & r else set() for s in rows], universe - r)]


def huffman(text: str) -> dict[str, str]:
    """Codes of a text's letters."""
    counts: dict[str, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    heap = [(n, k, {c: ""}) for k, (c, n) in enumerate(sorted(counts.items()))]
    if len(heap) == 1:
        return {heap[0][2].popitem()[0]: "0"}
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        n, _, a = heapq.heappop(heap)
        m, _, b = heapq.heappop(heap)
        heapq.heappush(heap, (n + m, k, {c: "0" + x for c, x in a.items()} | {c: "1" + x for c, x in b.items()}))
        k += 1
    return heap[0][2] if heap else {}


def lz77(data: bytes, window: int = 4096, most: int = 255) -> list[tuple[int, int, int]]:
    """(distance, length, next byte or -1)."""
    out, i = [], 0
    while i < len(data):
        best, back = 0, 0
        size = 3
        while size <= most and i + size <= len(data) and (at := data.rfind(data[i : i + size], max(0, i - window), i + size - 1)) >= 0:
            best, back = size, i - at
            size += 1
        i += best
        out.append((back, best, data[i] if i < len(data) else -1))
        i += 1
    return out


def unlz77(codes: list[tuple[int, int, int]]) -> bytes:
    out = bytearray()
    for back, size, byte in codes:
        for _ in range(size):
            out.append(out[-back])
        if byte >= 0:
            out.append(byte)
    return bytes(out)


def word_on_board(board: list[str], word: str) -> bool:
    """Whether a word runs over neighbouring cells, none used twice."""

    def go(r, c, k, used):
        if k == len(word):
            return True
        if not (0 <= r < len(board) and 0 <= c < len(board[r])) or (r, c) in used or board[r][c] != word[k]:
            return False
        return any(go(r + a, c + b, k + 1, used | {(r, c)}) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))

    return not word or any(go(r, c, 0, frozenset()) for r in range(len(board)) for c in range(len(board[r])))


def knights_tour(n: int, start: tuple[int, int] = (0, 0)) -> list[tuple[int, int]] | None:
    """A tour of an n x n board, going where fewest moves are left."""
    moves = [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]
    seen = {start}
    free = lambda p: [q for a, b in moves if 0 <= (q := (p[0] + a, p[1] + b))[0] < n and 0 <= q[1] < n and q not in seen]
    path = [start]

    def go():
        if len(path) == n * n:
            return True
        for q in sorted(free(path[-1]), key=lambda q: (len(free(q)), q)):
            path.append(q)
            seen.add(q)
            if go():
                return True
            path.pop()
            seen.discard(q)
        return False

    return path if go() else None

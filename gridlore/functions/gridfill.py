"""Missing cells of a grid by linear interpolation over triangles of the known cells around them."""

from __future__ import annotations

import numpy as np

#: Share of missing cells from which a filled grid is smoothed.
SMOOTHED = 0.1

Point = tuple[int, int]


def _turn(a: Point, b: Point, c: Point) -> int:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _in_circle(a: Point, b: Point, c: Point, p: Point) -> bool:
    """Whether p lies inside the circle through a counter-clockwise triangle, in whole numbers."""
    rows = [(q[0] - p[0], q[1] - p[1]) for q in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    sa, sb, sc = (x * x + y * y for x, y in rows)
    return ax * (by * sc - sb * cy) - ay * (bx * sc - sb * cx) + sa * (bx * cy - by * cx) > 0


def delaunay(points: list[Point]) -> list[tuple[Point, Point, Point]]:
    """Counter-clockwise triangles whose circles hold no other point; of points on one circle the order decides."""
    span = 1 + max(max(abs(x), abs(y)) for x, y in points)
    far = ((-40 * span, -40 * span), (40 * span, -40 * span), (0, 60 * span))
    triangles = [far]
    for p in sorted(points):
        gone = [t for t in triangles if _in_circle(*t, p)]
        edges = {(t[k], t[(k + 1) % 3]) for t in gone for k in range(3)}
        rim = [e for e in edges if (e[1], e[0]) not in edges]
        triangles = [t for t in triangles if t not in gone] + [(a, b, p) for a, b in rim if _turn(a, b, p) > 0]
    return [t for t in triangles if not set(t) & set(far)]


def holes(missing: np.ndarray) -> list[list[Point]]:
    """The cells of each group of missing cells that touch, corners included."""
    left = set(map(tuple, np.argwhere(missing).tolist()))
    out = []
    while left:
        group, open_ = [], [left.pop()]
        while open_:
            r, c = cell = open_.pop()
            group.append(cell)
            for n in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    open_.append(n)
        out.append(sorted(group))
    return sorted(out)


def fill_holes(z: np.ndarray) -> np.ndarray:
    """z with its NaN cells filled: over the triangles of the known cells up to two around a hole, or with the mean outside of them."""
    known = ~np.isnan(z)
    n = int(known.sum())
    out = z.copy()
    if n == z.size:
        return out
    if not n:
        return np.zeros_like(z)
    out[~known] = z[known].mean()
    if n <= 3:
        return out
    for group in holes(~known):
        around = {(r + i, c + j) for r, c in group for i in range(-2, 3) for j in range(-2, 3)}
        ring = [p for p in around if 0 <= p[0] < z.shape[0] and 0 <= p[1] < z.shape[1] and known[p]]
        triangles = delaunay(ring) if len(ring) >= 3 else []
        for p in group:
            for a, b, c in triangles:
                u, v, w = _turn(b, c, p), _turn(c, a, p), _turn(a, b, p)
                if u >= 0 and v >= 0 and w >= 0 and u + v + w > 0:
                    out[p] = (u * z[a] + v * z[b] + w * z[c]) / (u + v + w)
                    break
    return out


def median_3x3(z: np.ndarray) -> np.ndarray:
    p = np.pad(z, 1, mode="edge")
    rows, cols = z.shape
    return np.median([p[i : i + rows, j : j + cols] for i in range(3) for j in range(3)], axis=0)


def filled(row: np.ndarray, col: np.ndarray, z: np.ndarray) -> np.ndarray:
    """z of the cells (row, col) with missing ones filled; cells that are not there count as missing."""
    if not len(z):
        return z
    r, c = row - row.min(), col - col.min()
    grid = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan)
    grid[r, c] = z
    missing = int(np.isnan(grid).sum())
    whole = fill_holes(grid)
    if grid.size > missing > SMOOTHED * grid.size:
        whole = median_3x3(whole)
    return whole[r, c]

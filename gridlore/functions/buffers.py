"""Areas of round buffers, for many lines at once.

A buffer is a union of convex pieces: a rectangle a segment, and sectors at joints and ends (see `plane.buffer_line`). Its area is
that under its boundary, which is what the pieces' edges have outside of all other pieces. So each edge is cut with each piece of its
line, as a stretch of the edge between 0 and 1, and what no stretch covers counts. Pieces lie on the grid of `plane.combine`, so sides are told exactly,
and ends of stretches are rounded to it. Of equal edges the first piece's counts; edges that run against each other have the inside on both sides.
"""

from __future__ import annotations

import math

import numpy as np

from gridlore.functions import plane

#: Pairs of edges and pieces that are looked at side by side.
_PAIRS = 1 << 17
#: Grid units by which rounding moves a point at most, with room to spare.
_SLACK = 2.0
#: Half a width over a line's extent, from which on rounded arcs are convex; and the least turn whose sector the grid tells from a line.
_THIN, _TURN = 2.0**-12, 1e-7


def round_areas(points: np.ndarray, first: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The area within `half` of each line, with round ends and joints: line k has the points first[k] to first[k + 1] of a table of x and y."""
    points, first, half = np.asarray(points, float).reshape(-1, 2), np.asarray(first, np.int64), np.asarray(half, float)
    line = np.repeat(np.arange(len(half)), np.diff(first))
    new = np.ones(len(points), bool)
    new[1:] = (line[1:] != line[:-1]) | (points[1:] != points[:-1]).any(1)
    n = np.bincount(line[new], minlength=len(half))
    # At most a quarter and a half of a circle's edges a joint, and four a segment.
    cost = (n * (2 * plane.QUARTER + 6) + 4 * plane.QUARTER) * (2 * n + 1)
    finite = np.bincount(line, ~np.isfinite(points).all(1), len(half)) == 0
    low, high, size = np.full((len(half), 2), np.inf), np.full((len(half), 2), -np.inf), np.zeros(len(half))
    held = np.flatnonzero(np.diff(first))
    if len(held):
        low[held], high[held] = np.minimum.reduceat(points, first[held]), np.maximum.reduceat(points, first[held])
        size[held] = (high[held] - low[held]).max(1) * _THIN + np.maximum(-low[held], high[held]).max(1) * 1e-9
    # One by one: lines that are a point or not finite or that are united piece by piece, and widths that are few units of the grid or of a float next to the points.
    alone = (n < 2) | ~finite | ~(half > size) | ~np.isfinite(half) | (n * (2 * plane.QUARTER + 6) + 4 * plane.QUARTER > plane._AT_ONCE)
    out = np.zeros(len(half))
    for k in np.flatnonzero(alone):
        out[k] = plane.area(plane.buffer_line(points[first[k] : first[k + 1]], half[k]))
    some = new & ~alone[line]
    p, line = points[some], line[some]
    many = np.flatnonzero(~alone)
    group = np.cumsum(cost[many]) // _PAIRS
    for lines in np.split(many, np.flatnonzero(np.diff(group)) + 1):
        if len(lines):
            at = slice(*np.searchsorted(line, (lines[0], lines[-1] + 1)))
            out[lines] = _areas(p[at], np.searchsorted(lines, line[at]), half[lines])
    return out


def _ragged(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of n rows, each row's group and its place there."""
    group = np.repeat(np.arange(len(n)), n)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)


def _near(on, own, lines, piece, mx, my, reach, centre, length, width, d, free) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an edge and another rectangle of its line that may meet, without those of edges that lie well within one; these are marked as not free."""
    n = np.bincount(own, minlength=lines)
    begin = np.cumsum(n) - n
    out = []
    # The k-th rectangle of each line.
    for k in range(int(n.max())):
        has = n > k
        i = np.flatnonzero(has[on] & free)
        j = (begin + np.where(has, k, 0))[on[i]]
        x, y, r, ux, uy = mx[i] - centre[0][j], my[i] - centre[1][j], reach[i], d[0][j], d[1][j]
        across = np.abs(x * uy - y * ux) - width[j]
        along = np.abs(x * ux + y * uy) - length[j]
        most = np.maximum(across, along, out=across)
        other = piece[i] != j
        free[i[np.flatnonzero((most < -r) & other)]] = False
        near = np.flatnonzero((most < r) & other)
        out.append((i[near], j[near]))
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    some = np.flatnonzero(free[i])
    return i[some], j[some]


def _around(on, of, lines, piece, mx, my, reach, middle, radius, start, stop, free) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an edge that is free and another sector of its line that may meet; start and stop are the directions of the sector's sides."""
    n = np.bincount(of, minlength=lines)
    begin = np.cumsum(n) - n
    out = []
    for k in range(int(n.max())):
        has = n > k
        i = np.flatnonzero(has[on] & free)
        j = (begin + np.where(has, k, 0))[on[i]]
        x, y, r = mx[i] - middle[0][j], my[i] - middle[1][j], reach[i]
        near = np.flatnonzero((x * x + y * y < (r + radius[j]) ** 2) & (piece[i] != j))
        i, j, x, y, r = i[near], j[near], x[near], y[near], r[near]
        near = np.flatnonzero((start[0][j] * y - start[1][j] * x > -r) & (stop[1][j] * x - stop[0][j] * y > -r))
        out.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Stretches:
    """Stretches t0 to t1 of edges, to be cut by sides with the inside on their left."""

    def __init__(self, edges: np.ndarray, e: np.ndarray, before: np.ndarray):
        #: before: whether the side's piece comes before the edge's own.
        self.e, self.before = e, before
        self.ax, self.ay, self.bx, self.by = (edges[k][e] for k in range(4))
        self.t0, self.t1, self.live = np.zeros(len(e)), np.ones(len(e)), np.ones(len(e), bool)

    def cut(self, side: np.ndarray) -> None:
        x, y, dx, dy = side[0], side[1], side[2] - side[0], side[3] - side[1]
        a = dx * (self.ay - y) - dy * (self.ax - x)
        b = dx * (self.by - y) - dy * (self.bx - x)
        self.live &= (a > 0) | (b > 0)
        flat = np.flatnonzero((a == 0) & (b == 0))
        if len(flat):
            along = (self.bx[flat] - self.ax[flat]) * dx[flat] + (self.by[flat] - self.ay[flat]) * dy[flat]
            self.live[flat] = (along < 0) | self.before[flat]
        t = a / np.where(a == b, 1.0, a - b)
        np.maximum(self.t0, t, out=self.t0, where=a < 0)
        np.minimum(self.t1, t, out=self.t1, where=b < 0)

    def kept(self) -> np.ndarray:
        return np.flatnonzero(self.live & (self.t0 < self.t1))

    def take(self, k: np.ndarray) -> _Stretches:
        out = object.__new__(_Stretches)
        out.__dict__ = {name: v[k] for name, v in self.__dict__.items()}
        return out

    def told(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.e[k], self.t0[k], self.t1[k]


def _areas(p: np.ndarray, line: np.ndarray, half: np.ndarray) -> np.ndarray:
    lines = len(half)
    # Rectangles a segment.
    s = np.flatnonzero(line[1:] == line[:-1])
    a, b, own = p[s], p[s + 1], line[s]
    d = b - a
    d /= np.hypot(d[:, 0], d[:, 1])[:, None]
    n = np.stack((-d[:, 1], d[:, 0]), 1) * half[own][:, None]
    rects = np.stack((a - n, b - n, b + n, a + n), 1)
    # Sectors at joints, that of a closed line's ends included, and half circles at the ends of others.
    begin = np.searchsorted(own, np.arange(lines))
    end = np.append(begin[1:], len(own)) - 1
    closed = (a[begin] == b[end]).all(1)
    joint = np.flatnonzero(own[1:] == own[:-1])
    k0, k1 = np.concatenate((joint, end[closed])), np.concatenate((joint + 1, begin[closed]))
    turn = np.arctan2(plane._cross(*d[k0].T, *d[k1].T), (d[k0] * d[k1]).sum(1))
    bends = np.abs(turn) >= _TURN
    k0, k1, turn = k0[bends], k1[bends], turn[bends]
    begin, end = begin[~closed], end[~closed]
    centre = np.concatenate((a[k1], a[begin], b[end]))
    start = np.concatenate((np.where(turn[:, None] > 0, -n[k0], n[k1]), n[begin], -n[end]))
    whole = np.concatenate((np.abs(turn), np.full(2 * len(begin), math.pi)))
    pie = np.arange(len(centre)) < len(turn)
    of = np.concatenate((own[k1], own[begin], own[end]))
    order = np.argsort(of, kind="stable")
    centre, start, whole, pie, of = centre[order], start[order], whole[order], pie[order], of[order]
    chords = np.maximum(1, np.ceil(whole / (math.pi / 2) * plane.QUARTER - 1e-9)).astype(np.int64)
    sector, k = _ragged(chords + 1)
    last = np.cumsum(chords + 1) - 1
    head = last - chords
    over = lambda v: np.repeat(v, chords + 1)
    angle = over(np.arctan2(start[:, 1], start[:, 0])) + np.where(k == over(chords), over(whole), k * over(whole / chords))
    r = over(np.hypot(start[:, 0], start[:, 1]))
    arc = np.stack((over(centre[:, 0]) + r * np.cos(angle), over(centre[:, 1]) + r * np.sin(angle)))

    # All on each line's grid.
    some, at = np.unique(of, return_index=True)
    at_rect = np.searchsorted(own, np.arange(lines))
    low, high = np.minimum.reduceat(rects.min(1), at_rect), np.maximum.reduceat(rects.max(1), at_rect)
    low[some] = np.minimum(low[some], np.minimum.reduceat(np.minimum.reduceat(arc, head, axis=1), at, axis=1).T)
    high[some] = np.maximum(high[some], np.maximum.reduceat(np.maximum.reduceat(arc, head, axis=1), at, axis=1).T)
    unit = 2.0 ** (np.ceil(np.log2((high - low).max(1))) - plane.GRID_BITS)
    base = np.floor(low / unit[:, None]) * unit[:, None]
    rects = np.rint((rects - base[own][:, None]) / unit[own][:, None, None])
    middle = (centre - base[of]) / unit[of][:, None]
    apex = np.rint(middle)
    for c in (0, 1):
        arc[c] = np.rint((arc[c] - over(base[of, c])) / over(unit[of]))
    ends = arc[:, head].T, arc[:, last].T
    chord = np.ones(len(sector), bool)
    chord[last] = False
    chord = np.flatnonzero(chord)
    chord_sides = np.concatenate((arc[:, chord], arc[:, chord + 1]))
    # The sides through the centre; a half circle has one, twice.
    in_side = np.concatenate((np.where(pie[:, None], apex, ends[1]), ends[0]), 1).T
    out_side = np.concatenate((ends[1], np.where(pie[:, None], apex, ends[0])), 1).T
    rect_sides = [np.concatenate((rects[:, i], rects[:, (i + 1) % 4]), 1).T for i in range(4)]

    e = np.concatenate((*rect_sides, chord_sides, in_side, out_side[:, pie]), 1)
    piece = np.concatenate((np.tile(np.arange(len(own)), 4), len(own) + np.concatenate((sector[chord], np.arange(len(of)), np.flatnonzero(pie)))))
    some = (e[0] != e[2]) | (e[1] != e[3])
    if not some.all():
        e, piece = np.ascontiguousarray(e[:, some]), piece[some]
    on = np.concatenate((own, of))[piece]
    mx, my, reach = (e[0] + e[2]) / 2, (e[1] + e[3]) / 2, np.hypot(e[2] - e[0], e[3] - e[1]) / 2 + _SLACK
    radius = half / unit

    found, free = [], np.ones(len(on), bool)
    # Rectangles: by the edge's middle in the rectangle's own directions, then by the sides.
    i, j = _near(on, own, lines, piece, mx, my, reach, rects.mean(1).T, np.hypot(*(b - a).T) / unit[own] / 2, radius[own], d.T, free)
    cut = _Stretches(e, i, j < piece[i])
    for side in rect_sides:
        cut.cut(side[:, j])
    found.append(cut.told(cut.kept()))
    k, t0, t1 = found[0]
    free[k[(t0 <= 0) & (t1 >= 1)]] = False

    # Sectors: by the distance of the edge's middle, then by the sides through the centre.
    i, j = _around(on, of, lines, piece - len(own), mx, my, reach, middle.T, radius[of], start.T / half[of], (ends[1] - middle).T / radius[of], free)
    cut = _Stretches(e, i, j + len(own) < piece[i])
    for side in (in_side, out_side):
        cut.cut(side[:, j])
    some = cut.kept()
    cut, j = cut.take(some), j[some]
    # What is left lies within all chords, or beyond all, or is cut by those that the centre sees it through.
    vx, vy = cut.bx - cut.ax, cut.by - cut.ay
    x0, y0 = cut.ax + cut.t0 * vx - middle[j, 0], cut.ay + cut.t0 * vy - middle[j, 1]
    x1, y1 = cut.ax + cut.t1 * vx - middle[j, 0], cut.ay + cut.t1 * vy - middle[j, 1]
    r = radius[of][j]
    inner = np.maximum(r * math.cos(math.pi / 4 / plane.QUARTER) - _SLACK, 0) ** 2
    inside = (x0 * x0 + y0 * y0 < inner) & (x1 * x1 + y1 * y1 < inner)
    found.append(cut.told(np.flatnonzero(inside)))
    vx, vy = x1 - x0, y1 - y0
    t = np.clip(-(x0 * vx + y0 * vy) / np.maximum(vx * vx + vy * vy, 1e-300), 0, 1)
    vx, vy = x0 + t * vx, y0 + t * vy
    meets = np.flatnonzero(~inside & (vx * vx + vy * vy < (r + _SLACK) ** 2))
    if len(meets):
        cut, j = cut.take(meets), j[meets]
        # Angles from the middle of the arc, so that none is near the turn from minus pi to pi.
        half_way = np.arctan2(start[:, 1], start[:, 0]) + whole / 2
        ux, uy = np.cos(half_way)[j], np.sin(half_way)[j]
        seen = [(np.arctan2(ux * y - uy * x, ux * x + uy * y) / whole[j] + 0.5) * chords[j] for x, y in ((x0[meets], y0[meets]), (x1[meets], y1[meets]))]
        least = np.clip(np.floor(np.minimum(*seen)) - 1, 0, chords[j] - 1).astype(np.int64)
        n = np.clip(np.floor(np.maximum(*seen)) + 1, least, chords[j] - 1).astype(np.int64) - least + 1
        pair, k = _ragged(n)
        each = cut.take(pair)
        each.cut(chord_sides[:, ((np.cumsum(chords) - chords)[j] + least)[pair] + k])
        at = np.cumsum(n) - n
        cut.t0, cut.t1, cut.live = np.maximum.reduceat(each.t0, at), np.minimum.reduceat(each.t1, at), np.logical_and.reduceat(each.live, at)
        found.append(cut.told(cut.kept()))

    return _under(e, on, lines, free, *(np.concatenate(x) for x in zip(*found, strict=True))) * unit * unit


def _under(e: np.ndarray, on: np.ndarray, lines: int, free: np.ndarray, k: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> np.ndarray:
    """By line, the area under what the stretches t0 to t1 of edges k leave of those that are free, in grid units."""
    free[k[np.flatnonzero((t0 <= 0) & (t1 >= 1))]] = False
    some = np.flatnonzero(free[k])
    k, t0, t1 = k[some], t0[some], t1[some]
    order = np.lexsort((t0, k))
    k, t0, t1 = k[order], t0[order], t1[order]
    # The farthest end of the stretches so far, by doubling within an edge.
    step, most = 1, int(np.bincount(k).max(initial=0))
    while step < most:
        t1 = np.concatenate((t1[:step], np.where(k[step:] == k[:-step], np.maximum(t1[step:], t1[:-step]), t1[step:])))
        step *= 2
    fresh = np.ones(len(k) + 1, bool)
    fresh[1:-1] = k[1:] != k[:-1]
    since = np.where(fresh[:-1], 0.0, np.concatenate(([0.0], t1[:-1]))[: len(k)])
    gap, done = t0 > since, fresh[1:] & (t1 < 1)
    free[k] = False
    bare = np.flatnonzero(free)
    i = np.concatenate((bare, k[gap], k[done]))
    u0 = np.concatenate((np.zeros(len(bare)), since[gap], t1[done]))
    u1 = np.concatenate((np.ones(len(bare)), t0[gap], np.ones(int(done.sum()))))
    ax, ay, bx, by = e[:, i]
    at = lambda a, b, u: np.where(u == 1, b, np.rint(a + u * (b - a)))
    return np.bincount(on[i], plane._cross(at(ax, bx, u0), at(ay, by, u0), at(ax, bx, u1), at(ay, by, u1)), lines) / 2

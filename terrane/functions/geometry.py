"""Planar geometry kernels in numpy: clipping, Voronoi cells, rings, smoothing, hulls and buffers."""

from __future__ import annotations

import numpy as np


def inside_rings(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd test of points against closed rings."""
    odd = np.zeros(np.shape(x), bool)
    for r in rings:
        (x1, y1), (x2, y2) = r[:-1].T, r[1:].T
        cross = (y1 > y[..., None]) != (y2 > y[..., None])
        with np.errstate(divide="ignore", invalid="ignore"):
            left = x[..., None] < (x2 - x1) * (y[..., None] - y1) / (y2 - y1) + x1
        odd ^= (cross & left).sum(-1) % 2 == 1
    return odd


def clip_halfplane(poly: np.ndarray, labels: np.ndarray, normal: np.ndarray, offset: float, label: int):
    """The part of a convex polygon where normal . p <= offset; its new edge carries ``label``.

    ``labels[i]`` belongs to the edge from vertex i to the next.
    """
    side = poly @ normal - offset
    if (side <= 0).all():
        return poly, labels
    out, tags = [], []
    n = len(poly)
    for i in range(n):
        j = (i + 1) % n
        a, b = side[i], side[j]
        if a <= 0:
            out.append(poly[i])
            tags.append(labels[i])
        if (a <= 0) != (b <= 0):
            out.append(poly[i] + (poly[j] - poly[i]) * (a / (a - b)))
            tags.append(label if a <= 0 else labels[i])
    return np.array(out).reshape(-1, 2), np.array(tags, int)


def voronoi(points: np.ndarray, box: tuple[float, float, float, float]):
    """Per point the (vertices, neighbour of each edge) of its cell within a box; neighbour -1 is the box.

    Other points are met nearest first, until they are too far to cut what is left. Equal points share one cell's owner.
    """
    x0, x1, y0, y1 = box
    cells = []
    for i, p in enumerate(points):
        poly = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
        labels = np.full(4, -1)
        d2 = ((points - p) ** 2).sum(1)
        for j in np.argsort(d2, kind="stable"):
            if j == i or not len(poly):
                continue
            if d2[j] == 0:
                if j < i:
                    poly, labels = poly[:0], labels[:0]
                continue
            if d2[j] > 4 * ((poly - p) ** 2).sum(1).max():
                break
            normal = points[j] - p
            poly, labels = clip_halfplane(poly, labels, normal, normal @ (points[j] + p) / 2, int(j))
        cells.append((poly, labels))
    return cells


def clip_to_rings(a: np.ndarray, b: np.ndarray, rings: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The parts of a segment inside closed rings."""
    d = b - a
    ts = [0.0, 1.0]
    for r in rings:
        p, e = r[:-1], r[1:] - r[:-1]
        den = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((p[:, 0] - a[0]) * e[:, 1] - (p[:, 1] - a[1]) * e[:, 0]) / den
            u = ((p[:, 0] - a[0]) * d[1] - (p[:, 1] - a[1]) * d[0]) / den
        ts += t[(den != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)].tolist()
    ts = np.unique(ts)
    mid = a + d * ((ts[1:] + ts[:-1]) / 2)[:, None]
    keep = inside_rings(mid[:, 0], mid[:, 1], rings)
    parts: list[list[float]] = []
    for s, e, k in zip(ts[:-1], ts[1:], keep):
        if k and parts and parts[-1][1] == s:
            parts[-1][1] = e
        elif k:
            parts.append([s, e])
    return [(a + d * s, a + d * e) for s, e in parts]


def clip_to_convex(a: np.ndarray, b: np.ndarray, poly: np.ndarray):
    """The part of a segment inside a convex counter-clockwise polygon, or None."""
    t0, t1 = 0.0, 1.0
    d = b - a
    for p, q in zip(poly, np.roll(poly, -1, 0)):
        n = np.array([q[1] - p[1], p[0] - q[0]])
        num, den = n @ (p - a), n @ d
        if den > 0:
            t1 = min(t1, num / den)
        elif den < 0:
            t0 = max(t0, num / den)
        elif num < 0:
            return None
    return (a + d * t0, a + d * t1) if t1 - t0 > 1e-12 else None


def ring_area(r: np.ndarray) -> float:
    """Signed area of a ring, positive counter-clockwise."""
    x, y = r[:, 0], r[:, 1]
    return 0.5 * float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(q):
        out: list = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker; a closed ring keeps at least four points."""
    closed = len(line) > 3 and (line[0] == line[-1]).all()
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    if closed:
        keep[((line - line[0]) ** 2).sum(1).argmax()] = True
    stack = list(zip(np.nonzero(keep)[0][:-1], np.nonzero(keep)[0][1:]))
    while stack:
        s, e = stack.pop()
        if e - s < 2:
            continue
        d = point_segment(line[s + 1 : e], line[s], line[e])
        k = int(d.argmax())
        if d[k] > tolerance:
            m = s + 1 + k
            keep[m] = True
            stack += [(s, m), (m, e)]
    out = line[keep]
    return out if not closed or len(out) >= 4 else line


def chaikin(line: np.ndarray, rounds: int) -> np.ndarray:
    """Corner cutting at a quarter and three quarters of each edge; open lines keep their ends."""
    for _ in range(rounds):
        a, b = line[:-1], line[1:]
        cut = np.stack([0.75 * a + 0.25 * b, 0.25 * a + 0.75 * b], 1).reshape(-1, 2)
        closed = (line[0] == line[-1]).all()
        line = np.vstack([cut, cut[:1]]) if closed else np.vstack([line[:1], cut[1:-1], line[-1:]])
    return line


def point_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points to a segment."""
    d = b - a
    n = d @ d
    t = np.clip(((p - a) @ d) / n, 0, 1) if n > 0 else np.zeros(len(p))
    return np.sqrt(((p - a - t[:, None] * d) ** 2).sum(1))


def point_polyline(p: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Distance of points to a polyline."""
    return np.min([point_segment(p, a, b) for a, b in zip(line[:-1], line[1:])], axis=0)


def _slab(x: np.ndarray, step: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of t where low <= x + t step <= high."""
    with np.errstate(divide="ignore", invalid="ignore"):
        s, e = (low - x) / step, (high - x) / step
    flat, inside = step == 0, (x >= low) & (x <= high)
    s, e = np.minimum(s, e), np.maximum(s, e)
    return np.where(flat, np.where(inside, -np.inf, np.inf), s), np.where(flat, np.where(inside, np.inf, -np.inf), e)


def capsule_intervals(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (t0, t1) of each segment ab (rows of a and b) within ``width`` of segment pq; t0 > t1 where there is none.

    The neighbourhood is a rectangle between two discs and convex, so the range spans what the three cut out.
    """
    d = b - a
    t0, t1 = np.full(len(a), np.inf), np.full(len(a), -np.inf)
    parts = []
    for c in (p, q):
        f = a - c
        aa, bb, cc = (d * d).sum(1), (d * f).sum(1), (f * f).sum(1) - width * width
        root = np.sqrt(np.maximum(bb * bb - aa * cc, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            lo, hi = (-bb - root) / aa, (-bb + root) / aa
        hit = (bb * bb - aa * cc >= 0) & (aa > 0)
        point = (aa == 0) & (cc <= 0)
        parts.append((np.where(hit, lo, np.where(point, 0.0, np.inf)), np.where(hit, hi, np.where(point, 1.0, -np.inf))))
    e = q - p
    long = np.sqrt(e @ e)
    if long > 0:
        u, v = e / long, np.array([-e[1], e[0]]) / long
        s1, e1 = _slab((a - p) @ u, d @ u, 0.0, long)
        s2, e2 = _slab((a - p) @ v, d @ v, -width, width)
        parts.append((np.maximum(s1, s2), np.minimum(e1, e2)))
    for lo, hi in parts:
        lo, hi = np.maximum(lo, 0.0), np.minimum(hi, 1.0)
        some = lo <= hi
        t0, t1 = np.where(some, np.minimum(t0, lo), t0), np.where(some, np.maximum(t1, hi), t1)
    return t0, t1


def corridor_fraction(a: np.ndarray, b: np.ndarray, line: np.ndarray, width: float) -> np.ndarray:
    """Share of each segment ab (rows of a and b) that runs within ``width`` of a polyline."""
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    spans = np.stack([np.stack(capsule_intervals(a, b, p, q, width), 1) for p, q in zip(line[:-1], line[1:])], 1)
    order = np.argsort(spans[:, :, 0], axis=1)
    spans = np.take_along_axis(spans, order[:, :, None], 1)
    total, reach = np.zeros(len(a)), np.zeros(len(a))
    for k in range(spans.shape[1]):
        s, e = spans[:, k, 0], spans[:, k, 1]
        total += np.where(s <= e, np.maximum(0.0, e - np.maximum(s, reach)), 0.0)
        reach = np.maximum(reach, e)
    return total


def assemble(edges: np.ndarray, digits: int = 9) -> list[np.ndarray]:
    """Closed rings (first point repeated) from undirected edges (n, 2, 2) that meet end to end."""
    keys = [tuple(map(tuple, np.round(e, digits))) for e in edges]
    at: dict = {}
    for i, (a, b) in enumerate(keys):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    used = np.zeros(len(keys), bool)
    rings = []
    for i, (a, b) in enumerate(keys):
        if used[i]:
            continue
        used[i] = True
        ring = [a, b]
        while ring[-1] != a:
            nxt = next((k for k in at[ring[-1]] if not used[k]), None)
            if nxt is None:
                break
            used[nxt] = True
            p, q = keys[nxt]
            ring.append(q if p == ring[-1] else p)
        if ring[-1] == a and len(ring) > 3:
            rings.append(np.array(ring))
    return rings


def point_on_surface(rings: list[np.ndarray]) -> tuple[float, float]:
    """A point inside: the middle of the widest span along the middle line that misses all vertices."""
    ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
    middle = (ys[0] + ys[-1]) / 2
    k = int(np.clip(np.searchsorted(ys, middle), 1, len(ys) - 1))
    y = (ys[k - 1] + ys[k]) / 2
    xs = []
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r[:-1], r[1:]):
            if (y1 > y) != (y2 > y):
                xs.append((x2 - x1) * (y - y1) / (y2 - y1) + x1)
    xs = np.sort(xs)
    widths = xs[1::2] - xs[::2]
    w = int(widths.argmax())
    return float(xs[2 * w] + widths[w] / 2), float(y)

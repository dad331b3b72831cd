"""Points against the lines and polygons of their map, streamed: each key's map pieces come first, its points after them in batches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEY = ("log", "cx", "cy", "part")
INFO, LINE, RING, POINT = range(4)   # kinds of rows, in the order in which a key's rows come
PAIRS = 1 << 15   # point and segment pairs that are looked at together


class Piece:
    """The pieces of one key, and the search among them."""

    def __init__(self, targets, reach, far, segments):
        self.targets, self.reach, self.far, self.segments = targets, reach, far, segments
        self.bits, self.ways, self.lines, self.rings, self.cols, self.rows, self.closed = None, None, [], [], [], 0, False

    def polylines(self, at, stop, ends, x, y):
        """Consecutive points of the rows [at, stop) as segments, with the row and the place of each."""
        a, b = ends[at], ends[stop]
        size = ends[at + 1:stop + 1] - ends[at:stop]
        inner = np.ones(b - a, bool)
        inner[ends[at + 1:stop + 1] - 1 - a] = False
        row = np.repeat(np.arange(stop - at), size)[inner]
        place = (np.arange(b - a) - np.repeat(ends[at:stop] - a, size))[inner]
        first = np.flatnonzero(inner) + a
        return row, place, x[first], y[first], x[first + 1], y[first + 1]

    def add(self, at, stop, kind, line, seg, bits, ways, cols, ends, x, y):
        for k in (INFO, LINE, RING):
            i, j = at + np.searchsorted(kind[at:stop], [k, k + 1])
            if i == j:
                continue
            if k == INFO:
                self.bits, self.ways = int(bits[i]), int(ways[i])
                continue
            row, place, x0, y0, x1, y1 = self.polylines(i, j, ends, x, y)
            if k == RING:
                self.rings.append((line[i:j][row], x0, y0, x1, y1))
                continue
            self.lines.append((line[i:j][row], seg[i:j][row] + place, bits[i:j][row], row + self.rows, x0, y0, x1 - x0, y1 - y0))
            self.rows += j - i
            if cols is not None:
                self.cols.append(cols.slice(i, j - i))

    def close(self):
        """All pieces are there: one array for each of their columns."""
        if not self.closed:
            self.closed = True
            self.lines = [np.concatenate(c) for c in zip(*self.lines)] if self.lines else None
            self.rings = [np.concatenate(c) for c in zip(*self.rings)] if self.rings else None
            self.cols = pa.concat_arrays(self.cols) if self.cols else None
            if self.lines:
                line, seg, bits, row, sx, sy, ux, uy = self.lines
                if seg.max() >= self.segments:
                    raise ValueError(f"an order of up to {self.segments} places doesn't fit")
                self.start = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
                self.stop = np.r_[self.start[1:], len(line)]
                self.bad = ~np.isfinite(sx + sy + ux + uy)
                self.gone = np.logical_and.reduceat(self.bad, self.start)
                self.theta, self.square = np.arctan2(uy, ux), ux * ux + uy * uy + 1e-12
            if self.rings:
                self.ring = np.flatnonzero(np.r_[True, self.rings[0][1:] != self.rings[0][:-1]])

    def inside(self, x, y):
        found = np.zeros(len(x), bool)
        if self.rings:
            _, x0, y0, x1, y1 = self.rings
            for a, b in blocks(len(x), len(x0)):
                px, py = x[a:b, None], y[a:b, None]
                with np.errstate(all="ignore"):
                    hit = ((y1 > py) != (y0 > py)) & (px < (x1 - x0) * (py - y0) / (y1 - y0 + 1e-12) + x0)
                found[a:b] = (np.add.reduceat(hit.astype(np.int32), self.ring, axis=1) % 2 == 1).any(axis=1)
        return found

    def search(self, x, y, heading, known, out, at):
        """Write each target's nearest line into the arrays of ``out``, from place ``at`` on."""
        if not self.lines:
            return
        line, seg, bits, row, sx, sy, ux, uy = self.lines
        of_line = bits[self.start]
        placed = known & np.isfinite(x) & np.isfinite(y)
        for a, b in blocks(len(x), len(line)):
            with np.errstate(all="ignore"):
                dx, dy = x[a:b, None] - sx, y[a:b, None] - sy
                along = np.clip((dx * ux + dy * uy) / self.square, 0.0, 1.0)
                dx -= along * ux
                dy -= along * uy
                q = np.floor(np.sqrt(dx * dx + dy * dy) * 1e9 + 0.5)
            if self.bad.any():
                q[:, self.bad] = np.inf
            ok = placed[a:b]
            q[~ok] = np.inf
            best = np.minimum.reduceat(q, self.start, axis=1)
            if (np.isfinite(best) & (best >= (1 << 62) // self.segments)).any():
                raise ValueError(f"an order of up to {self.segments} places doesn't fit")
            for name, bit, directed in self.targets:
                mine = np.flatnonzero(of_line & bit)
                if not len(mine):
                    continue
                near = best[:, mine]
                if directed:
                    with np.errstate(all="ignore"):
                        turned = self.headings(q, mine) - heading[a:b, None]
                        ahead = np.abs(np.mod(turned + math.pi, 2 * math.pi) - math.pi) < math.pi / 2
                    near = np.where(ahead, near, np.inf)
                k = near.argmin(axis=1)
                d = near[np.arange(b - a), k]
                sure = np.isfinite(d) & (d <= (self.far if self.reach is None else self.reach))
                o = out[name]
                if self.reach is None:
                    # nothing near: a line without a place comes before all others, as a null does
                    lost = mine[self.gone[mine]]
                    none = known[a:b] & ~sure & (~ok | (len(lost) > 0))
                    if not directed and none.any():
                        for some, those in ((none & ok, lost), (none & ~ok, mine)):
                            rows = np.flatnonzero(some)
                            if len(rows):
                                o["line"][at + a + rows], o["row"][at + a + rows] = line[self.start[those[0]]], row[self.start[those[0]]]
                                o["found"][at + a + rows] = True
                    sure = np.isfinite(d) & ~(none if not directed else False)
                rows = np.flatnonzero(sure)
                if len(rows):
                    place = self.places(q, mine[k], rows)
                    to = at + a + rows
                    o["q"][to], o["line"][to], o["seg"][to], o["theta"][to], o["row"][to] = d[rows], line[place], seg[place], self.theta[place], row[place]
                    o["found"][to] = o["placed"][to] = True

    def headings(self, q, lines):
        """The heading of each of ``lines`` at its segment nearest to each point."""
        size = self.stop[lines] - self.start[lines]
        cols = np.repeat(self.start[lines] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        local = cols - np.repeat(self.start[lines], size)
        key = np.where(np.isfinite(q[:, cols]), q[:, cols], -1).astype(np.int64)
        key = np.where(key >= 0, key * self.segments + local, np.iinfo(np.int64).max)
        low = np.minimum.reduceat(key, np.r_[0, np.cumsum(size)[:-1]], axis=1)
        place = np.where(low == np.iinfo(np.int64).max, 0, low % self.segments)
        return self.theta[self.start[lines] + place]

    def places(self, q, lines, rows):
        """The first nearest segment of ``lines[r]`` for each r of ``rows``."""
        place = np.empty(len(rows), np.int64)
        mine = lines[rows]
        order = np.argsort(mine, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(mine[order])) + 1):
            a, b = self.start[mine[part[0]]], self.stop[mine[part[0]]]
            place[part] = a + q[rows[part], a:b].argmin(axis=1)
        return place


def blocks(points, pieces):
    size = max(1, PAIRS // max(1, pieces))
    return [(a, min(a + size, points)) for a in range(0, points, size)]


def numbers(column, dtype=None):
    """A column as numpy; a null is NaN, or 0 among integers."""
    if dtype is not None:
        return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def scanner(targets, reach, far, segments, kept, types, poly):
    """A function for ``mapInArrow``: rows sorted by key and kind to one row for each point.

    ``targets`` has (name, bit of the lines, whether only lines ahead count), ``reach`` the distance up to which a key's lines are all there (None:
    the whole map), ``kept`` the columns that points carry along, ``types`` the output's Arrow schema, ``poly`` the bit of logs with polygons."""
    def scan(batches):
        piece, key = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            new = np.zeros(n, bool)
            for c in KEY:
                new[1:] |= pc.not_equal(col[c].slice(1), col[c].slice(0, n - 1)).to_numpy(zero_copy_only=False)
            new[0] = key != (now := tuple(col[c][0].as_py() for c in KEY))
            begin = np.flatnonzero(np.r_[True, new[1:]])
            kind = numbers(col["kind"], np.int64)
            line, seg, bits, ways = (numbers(col[c], np.int64) for c in ("line", "seg", "bits", "ways"))
            x, y, heading = (numbers(col[c]) for c in ("x", "y", "heading"))
            px, py = (numbers(c) for c in col["pts"].values.flatten())
            ends = col["pts"].offsets.to_numpy().astype(np.int64)
            known = pc.is_valid(col["point"]).to_numpy(zero_copy_only=False)
            points = kind == POINT
            place = np.cumsum(points) - points
            m = int(points.sum())
            out = {t: {"q": np.zeros(m, np.int64), "line": np.zeros(m, np.int64), "seg": np.zeros(m, np.int64), "theta": np.zeros(m), "row": np.zeros(m, np.int64),
                       "found": np.zeros(m, bool), "placed": np.zeros(m, bool), "cols": []} for t, _, _ in targets}
            log_bits, log_ways, inside = bits[points].copy(), ways[points].copy(), np.zeros(m, bool)
            for a, b in zip(begin, np.r_[begin[1:], n]):
                if new[a]:
                    piece = Piece(targets, reach, far, segments)
                p = a + int(np.searchsorted(kind[a:b], POINT))
                if p > a:
                    piece.add(a, p, kind, line, seg, bits, ways, col.get("cols"), ends, px, py)
                if b > p:
                    piece.close()
                    at = int(place[p])
                    if piece.bits is not None:
                        log_bits[at:at + b - p], log_ways[at:at + b - p] = piece.bits, piece.ways
                    inside[at:at + b - p] = piece.inside(x[p:b], y[p:b])
                    piece.search(x[p:b], y[p:b], heading[p:b], known[p:b], out, at)
                    if "cols" in col:
                        for t in out.values():
                            row = pa.array(t["row"][at:at + b - p], mask=~t["found"][at:at + b - p])
                            t["cols"].append(piece.cols.take(row) if piece.cols is not None else pa.nulls(b - p, col["cols"].type))
            key = tuple(col[c][n - 1].as_py() for c in KEY) if n > 1 else now
            if not m:
                continue
            pick = pa.array(np.flatnonzero(points))
            had = numbers(pc.cast(col["inside"].take(pick), pa.int8()), np.int8) == 1
            has = (log_bits & poly) != 0
            found = [pa.array(log_bits), pa.array(log_ways), pa.array(inside | had, mask=~has)]
            for t, _, _ in targets:
                o = out[t]
                fields = [pa.array(o[c], mask=~o[g]) for c, g in (("q", "placed"), ("line", "found"), ("seg", "placed"), ("theta", "placed"))]
                if "cols" in col:
                    fields.append(pa.concat_arrays(o["cols"]))
                kind_of = types.field(t).type
                fields = [f.cast(kind_of.field(i).type) if f.type != kind_of.field(i).type else f for i, f in enumerate(fields)]
                found.append(pa.StructArray.from_arrays(fields, fields=[kind_of.field(i) for i in range(kind_of.num_fields)], mask=pa.array(~o["found"])))
            yield pa.RecordBatch.from_arrays([*(col[c].take(pick) for c in kept), *found], names=types.names)
    return scan

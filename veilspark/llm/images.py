"""Operator 4: cropped and edited copies of images by local descriptors.

Corners on all scales that an image has room for are described by binary intensity tests,
turned by the orientation of their patch.  There is no number of corners: every local
maximum whose tests tell enough apart is one, so a crop keeps those of its part, and a large
image has more.  Descriptors meet in Hamming tables (by pigeonhole, two that differ in fewer
bits than there are tables agree in one of them); pairs of images whose matches agree on one
similarity transform, first by vote and then by fit, are linked, and links make groups.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, only, trim
from .simhash import components

RADIUS, TESTS, TURNS = 16, 256, 36
#: Parts of a cell: how far apart points must lie to count twice, and how near to the transform they must lie.
APART, TIGHT = 3, 12
#: Of the corners of the image with fewer of them, those that must agree.
SHARE = 0.08
LEVELS = tuple(2 ** (i / 2) for i in range(16))
#: Grey values by which a test must differ to tell something, and the share of tests of a corner that must.
TOLD, TELLING = 10.0, 0.75
HEADER = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def decode(blob: bytes) -> np.ndarray | None:
    """Grey values of a binary PGM or an 8-bit PNG that is not interlaced; null for anything else."""
    try:
        if m := HEADER.match(blob):
            width, height, top = map(int, m.groups())
            size = width * height
            if top > 255 or not size:
                return None
            return np.frombuffer(blob[m.end() : m.end() + size], np.uint8).reshape(height, width).astype(np.float32)
        if blob[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(blob)
    except (ValueError, IndexError, struct.error, zlib.error):
        pass
    return None


def _png(blob: bytes) -> np.ndarray | None:
    at, data = 8, b""
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", blob[16:29])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or interlaced or not channels or not width or not height:
        return None
    while at < len(blob):
        size, name = struct.unpack(">I4s", blob[at : at + 8])
        if name == b"IDAT":
            data += blob[at + 8 : at + 8 + size]
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.int32)
    above = np.zeros(width * channels, np.int32)
    for y in range(height):
        line, mode = rows[y, 1:].astype(np.int32), rows[y, 0]
        if mode == 2:
            line = (line + above) & 255
        elif mode:
            for x in range(len(line)):
                left, corner = (line[x - channels], above[x - channels]) if x >= channels else (0, 0)
                up = above[x]
                if mode == 4:
                    p = left + up - corner
                    near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + (left if mode == 1 else (left + up) // 2 if mode == 3 else near)) & 255
        out[y] = above = line
    color = out.reshape(height, width, channels).astype(np.float32)
    return color[..., 0] if channels < 3 else color[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)


def box(image: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of ``2r + 1``, of the same shape."""
    padded = np.pad(image, ((r + 1, r), (r + 1, r)), mode="edge").cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    n = 2 * r + 1
    return (padded[n:, n:] - padded[:-n, n:] - padded[n:, :-n] + padded[:-n, :-n]) / (n * n)


def resized(image: np.ndarray, by: float) -> np.ndarray:
    """Smaller by a factor, bilinear after smoothing."""
    if by == 1:
        return image
    smooth = box(image, 1)
    h, w = int(image.shape[0] / by), int(image.shape[1] / by)
    y, x = np.arange(h) * by, np.arange(w) * by
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = smooth[y0][:, x0] * (1 - fx) + smooth[y0][:, x1] * fx
    low = smooth[y1][:, x0] * (1 - fx) + smooth[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


@lru_cache(maxsize=1)
def patterns() -> np.ndarray:
    """Test points for every turn: turn, test, end, (dy, dx)."""
    rng = np.random.default_rng(11)
    turned, far = rng.uniform(0, 2 * np.pi, (TESTS, 2)), (RADIUS - 2) * np.sqrt(rng.uniform(0, 1, (TESTS, 2)))
    points = np.stack((far * np.sin(turned), far * np.cos(turned)), axis=-1)
    turns = 2 * np.pi * np.arange(TURNS) / TURNS
    c, s = np.cos(turns)[:, None, None], np.sin(turns)[:, None, None]
    y, x = points[..., 0][None], points[..., 1][None]
    return np.rint(np.stack((s * x + c * y, c * x - s * y), axis=-1)).astype(np.int64)


@lru_cache(maxsize=1)
def disc() -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    inside = y * y + x * x <= RADIUS * RADIUS
    return y[inside], x[inside]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All corners: (x, y, scale, angle) in pixels of the image, and packed descriptors."""
    places, marks = [], []
    for scale in LEVELS:
        level = resized(image, scale)
        if min(level.shape) < 2 * RADIUS + 6:
            break
        gy, gx = np.gradient(level)
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        harris = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 1
        peak = harris[1:-1, 1:-1].copy()
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    peak = np.maximum(peak, harris[dy : dy + peak.shape[0], dx : dx + peak.shape[1]])
        core = harris[m : harris.shape[0] - m, m : harris.shape[1] - m]
        y, x = np.nonzero((core >= peak[m - 1 : m - 1 + core.shape[0], m - 1 : m - 1 + core.shape[1]]) & (core > 1.0))
        if not len(y):
            continue
        y, x, smooth = y + m, x + m, box(level, 2)
        dy, dx = disc()
        for at in range(0, len(y), 2000):  # bounds the patches held at a time
            v, u = y[at : at + 2000], x[at : at + 2000]
            patch = level[v[:, None] + dy, u[:, None] + dx]
            angle = np.arctan2(patch @ dy, patch @ dx)
            ends = patterns()[np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS]
            ends = smooth[v[:, None, None] + ends[..., 0], u[:, None, None] + ends[..., 1]]
            rise = ends[..., 1] - ends[..., 0]
            telling = (np.abs(rise) > TOLD).mean(axis=1) >= TELLING
            marks.append(np.packbits(rise[telling] > 0, axis=1))
            places.append(np.stack((u * scale, v * scale, np.full(len(u), scale), angle), axis=1)[telling])
    if not places:
        return np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8)
    return np.concatenate(places), np.concatenate(marks)


DESCRIBED = "row long, media_id long, content long, spot long, d0 long, d1 long, d2 long, d3 long, decoded boolean"
WORDS = ("d0", "d1", "d2", "d3")
ANGLES = 1024


def spots(places: np.ndarray) -> np.ndarray:
    """Place, scale and angle of an image's corners in one number each: 16 bits of their number, 16 of x, 16 of y, 4 of scale, 10 of angle."""
    x, y, scale, angle = places.T
    level = np.rint(2 * np.log2(scale)).astype(np.int64)
    turn = np.rint(angle / (2 * np.pi) * ANGLES).astype(np.int64) % ANGLES
    return (min(len(places), (1 << 16) - 1) << 46) | (np.rint(x).astype(np.int64) << 30) | (np.rint(y).astype(np.int64) << 14) | (level << 10) | turn


def descriptors(media: DataFrame) -> DataFrame:
    """One row per corner, and one without a descriptor for each image; row: a number of the image's row, content: a hash of the image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DESCRIBED.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part, out = batch.slice(at, 200), []
                for row, key, blob in zip(*(part.column(c).to_pylist() for c in ("row", "media_id", "image")), strict=True):
                    content = int.from_bytes(hashlib.sha256(blob or b"").digest()[:8], "big", signed=True)
                    image = decode(blob) if blob else None
                    places, marks = describe(image) if image is not None else (np.zeros((0, 4)), np.zeros((0, TESTS // 8), np.uint8))
                    words = np.ascontiguousarray(marks).view("<i8").tolist()
                    out.append((row, key, content, None, *[None] * 4, image is not None))
                    out += [(row, key, content, s, *w, True) for s, w in zip(spots(places).tolist(), words, strict=True)]
                kinds = [pa.int64()] * 8 + [pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                del out
                trim()

    return only(media, "media_id", "image").withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, DESCRIBED)


def piece(i: int, j: int) -> Column:
    """The key of one 32-bit piece of a descriptor."""
    return F.xxhash64(F.lit(2 * i + j), F.shiftrightunsigned(WORDS[i], 32 * j).bitwiseAND(0xFFFFFFFF))


def close(keys: np.ndarray, words: np.ndarray, known: np.ndarray, order: np.ndarray, theirs: np.ndarray, reach: int, upto: np.ndarray | None = None, step: int = 1 << 17, dense: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``words``, row of ``theirs``) with equal keys of which at most ``reach`` bits differ; about ``step`` are compared at a time.

    ``known`` has the keys of ``theirs`` in order, ``order`` the rows that they belong to; ``upto``: for each
    row of ``words`` the place there from which on it is not compared; it grows with the rows of a key.  Keys with ``dense`` pairs
    or more are compared in blocks of their rows, which are read once a block, others pair by pair.
    """
    if not len(keys):
        return
    by = np.argsort(keys, kind="stable").astype(np.uint32)
    start = np.flatnonzero(np.concatenate(([True], keys[by][1:] != keys[by][:-1])))
    size, own = np.diff(start, append=len(by)), keys[by[start]]
    first = np.searchsorted(known, own, "left")
    ends = np.repeat(np.searchsorted(known, own, "right"), size)
    if upto is not None:
        ends = np.minimum(ends, upto[by])
    pairs = np.add.reduceat(ends, start) - first * size
    big = (pairs >= dense) & (size >= 4)
    tall, wide = 128, 512  # a block stays in the processor's caches
    off, part, bits = np.empty(tall * wide, np.uint8), np.empty(tall * wide, np.uint8), np.empty(tall * wide, np.uint64)
    for at, many, begin in zip(start[big].tolist(), size[big].tolist(), first[big].tolist()):
        end = int(ends[at + many - 1])
        y = order[begin:end]
        other = np.ascontiguousarray(theirs[y].T)
        for top in range(at, at + many, tall):
            rows, last = by[top : min(top + tall, at + many)], ends[top : min(top + tall, at + many)] - begin
            mine = np.ascontiguousarray(words[rows].T)[:, :, None]
            width = max(wide, tall * wide // len(rows))
            for left in range(0, int(last[-1]), width):
                right = min(left + width, int(last[-1]))
                shape = (len(rows), right - left)
                n = shape[0] * shape[1]
                o, c, x = off[:n].reshape(shape), part[:n].reshape(shape), bits[:n].reshape(shape)
                np.bitwise_count(np.bitwise_xor(mine[0], other[0, left:right], out=x), out=o)
                for k in (1, 2, 3):  # a piece is equal, so the sum fits into a byte
                    np.add(o, np.bitwise_count(np.bitwise_xor(mine[k], other[k, left:right], out=x), out=c), out=o)
                hit = o <= reach
                if upto is not None and last[0] < right:
                    hit &= np.arange(left, right) < last[:, None]
                each = np.count_nonzero(hit, axis=1)
                if each.any():
                    yield np.repeat(rows, each), y[np.flatnonzero(hit) - np.repeat(np.arange(len(rows)) * shape[1] - left, each)]
    few = np.repeat(~big, size)
    thin, low = by[few], np.repeat(first, size)[few]
    n = ends[few] - low
    edge = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(thin):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + step, "right")) - 1)
        x = np.repeat(thin[at:to], n[at:to])
        y = order[np.arange(len(x)) + np.repeat(low[at:to] - edge[at:to] + edge[at], n[at:to])]
        count = np.bitwise_count(np.take(words, x, axis=0) ^ np.take(theirs, y, axis=0)).view(np.uint32).ravel()
        keep = np.flatnonzero(count * np.uint32(0x01010101) >> np.uint32(24) <= reach)  # the sum of four bytes
        if len(keep):
            yield x[keep], y[keep]
        at = to


def several_corners(pair: np.ndarray, x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """The matches of pairs of images that have ``need`` matches, and as many corners on either side; no others can agree."""
    at = np.flatnonzero(np.bincount(pair)[pair] >= need) if len(pair) else np.zeros(0, np.int64)
    for side in (x, y):
        if len(at):
            key = np.sort(pair[at].astype(np.int64) << 32 | side[at])  # rows of either side have 32 bits at most
            new = np.concatenate(([True], key[1:] != key[:-1]))
            at = at[np.bincount(key[new] >> 32)[pair[at]] >= need[at]]
    return at


def meet(left: tuple, right: tuple, known: np.ndarray, reach: int, least: int, same: bool, span: int = 1 << 17, most: int = 1 << 22, cells: int = 1 << 21) -> Iterator[np.ndarray]:
    """Matches (image and spot of the left side, of the right side) between two sets of corners (ids, spots, words).

    ``left`` is sorted by id; ``known``, sorted likewise, has matches found before.  All matches of
    a pair of images come together; pairs with fewer than ``least`` may be left out.  Where both sides are
    the ``same``, the left image is the one with the larger id.  About ``span`` corners of the left side are
    compared at a time, so that keys have many of them, or fewer while these have over ``most`` matches: one image at least.
    """
    (ids, spot, words), (other, there, theirs) = left, right
    parts, near = words.view("<u4"), theirs.view("<u4")
    images, place = np.unique(other, return_inverse=True)
    place = place.astype(np.int32)
    begins = np.append(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))), len(ids)) if len(ids) else np.zeros(1, np.int64)  # of the left images
    tables = [(near[order, i], order) for i in range(8) for order in [np.argsort(near[:, i], kind="stable").astype(np.uint32)]]
    ranks: list[np.ndarray | None] = [None] * 8
    if same:  # of rows with a key those before it have the smaller ids
        for i, (_, order) in enumerate(tables):
            ranks[i] = np.empty(len(order), np.uint32)
            ranks[i][order] = np.arange(len(order), dtype=np.uint32)

    def matches(at: int, to: int, stop: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows of both sides that match; none if there are over ``most`` and it may ``stop``."""
        xs, ys, n = [], [], 0
        for i, (keys, order) in enumerate(tables):
            for x, y in close(parts[at:to, i], words[at:to], keys, order, theirs, reach, None if ranks[i] is None else ranks[i][at:to].astype(np.int64)):
                xs.append(x)
                ys.append(y)
                n += len(x)
                if n > most and stop:
                    return None
        x, y = (np.concatenate(z or [np.zeros(0, np.uint32)]) for z in (xs, ys))
        x += np.uint32(at)
        if same:
            keep = ids[x] > other[y]
            x, y = x[keep], y[keep]
        return x, y

    at = done = 0  # images of the left side, and known matches, that are through
    width, per = max(1, span // 16), max(1, cells // max(1, len(images)))
    while at < len(begins) - 1:
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + width, "right")) - 1)
        if (found := matches(int(begins[at]), int(begins[to]), to > at + 1)) is None:
            width = int(begins[to] - begins[at]) // 2
            continue
        x, y = found
        width = int(min(span, 2 * width, 0.75 * most / max(1, len(x)) * (begins[to] - begins[at]) + 1))
        run = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(begins[at : to + 1]))[x - np.uint32(begins[at])]
        code = run.astype(np.int64) * len(images) + place[y]  # of the pair of images
        # images of a few at a time are counted in an array of ``cells``; where most pairs have no match, all are sorted
        sparse = (to - at) * len(images) > 16 * max(len(x), cells)
        step = to - at if sparse else per
        turn = (run // step).astype(np.uint16)
        order = np.argsort(turn, kind="stable")
        x, y, code = x[order], y[order], code[order]
        edges = np.concatenate(([0], np.cumsum(np.bincount(turn, minlength=-(-(to - at) // step)))))
        for n, first in enumerate(range(at, to, step)):
            end, rows = min(first + step, to), slice(edges[n], edges[n + 1])
            u, v, c = x[rows], y[rows], code[rows]
            pair = np.unique(c, return_inverse=True)[1] if sparse else c - (first - at) * len(images)
            upto = int(np.searchsorted(known[0], ids[begins[end] - 1], "right"))
            before = known[:, done:upto]
            enough = np.zeros(len(pair), bool)
            some = np.flatnonzero(np.bincount(pair)[pair] >= least) if len(pair) else np.zeros(0, np.int64)
            need = np.maximum(least, np.ceil(SHARE * np.minimum(spot[u[some]] >> 46, there[v[some]] >> 46))).astype(np.int64)
            enough[some[several_corners(pair[some], u[some], v[some], need)]] = True
            if before.shape[1] and len(c):
                mine = ids[begins[first:end]]
                i, j = (np.minimum(np.searchsorted(z, before[k]), len(z) - 1) for z, k in ((mine, 0), (images, 2)))
                enough |= np.isin(c, ((i + first - at) * len(images) + j)[(mine[i] == before[0]) & (images[j] == before[2])])
            u, v = u[enough], v[enough]
            yield np.concatenate((np.stack((ids[u], spot[u], other[v], there[v])), before), axis=1)
            done = upto
        at = to
    yield known[:, done:]


def numbers(*columns: np.ndarray) -> np.ndarray:
    """The number of each row's group of equal rows."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def read_spots(spot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, level and angle of ``spots``."""
    return tuple(((spot >> shift) & ((1 << bits) - 1)).astype(np.float64) for shift, bits in ((30, 16), (14, 16), (10, 4), (0, 10)))


def agreeing(m: np.ndarray, least: int) -> np.ndarray:
    """Pairs of images, from matches as of ``meet``, of which ``least`` corners, and a share of all, agree on a shift, turn and scale.

    They vote in cells that overlap by half and are as wide as a fifth of the images; where
    enough agree, a similarity is fitted to them, and so many must lie on it.
    """

    def several(group: np.ndarray) -> np.ndarray:
        return np.bincount(group)[group] >= least if len(group) else np.zeros(0, bool)

    m = m[:, several(numbers(m[0], m[2]))]
    if not m.shape[1]:
        return m[[0, 2]]
    pair = numbers(m[0], m[2])
    (px, py, pl, pt), (qx, qy, ql, qt) = (read_spots(c) for c in m[[1, 3]])
    turn, grow = (pt - qt) / ANGLES, 2.0 ** ((pl - ql) / 2)
    c, s = np.cos(2 * np.pi * turn), np.sin(2 * np.pi * turn)
    sx, sy = px - grow * (c * qx - s * qy), py - grow * (s * qx + c * qy)
    extent = np.zeros(pair.max() + 1)
    np.maximum.at(extent, pair, np.maximum.reduce([px, py, grow * qx, grow * qy]))
    wide = np.maximum(24.0, extent / 5)[pair]
    need = np.maximum(least, np.ceil(SHARE * np.minimum(m[1] >> 46, m[3] >> 46))).astype(np.int64)  # the more corners, the more agree by chance
    good = np.zeros(len(extent), bool)  # pairs that are linked
    for i, j, k in [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]:
        key = pair.astype(np.uint64)  # 26 bits, then 4, 15, 15 and 4: no two cells share a number
        for value, bits in ((pl - ql + 8, 4), (np.floor(sx / wide + i / 2) + (1 << 14), 15), (np.floor(sy / wide + j / 2) + (1 << 14), 15), (np.floor((turn * 12 + k / 2) % 12.0), 4)):
            key = key << np.uint64(bits) | value.astype(np.uint64)
        order = np.argsort(key)
        edge = np.append(np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))), len(key))
        sizes = np.diff(edge)
        enough = sizes >= need[order[edge[:-1]]]
        for cell in np.argsort(np.where(enough, -sizes, 0), kind="stable")[: np.count_nonzero(enough)].tolist():
            rows = order[edge[cell] : edge[cell + 1]]
            if not good[pair[rows[0]]] and fits(px[rows] + 1j * py[rows], qx[rows] + 1j * qy[rows], wide[rows[0]], int(need[rows[0]])):
                good[pair[rows[0]]] = True
    return np.unique(m[[0, 2]][:, good[pair]], axis=1)


def fits(p: np.ndarray, q: np.ndarray, wide: float, least: int, rounds: int = 4) -> bool:
    """Whether ``least`` points on either side, each a third of a cell or so from the next, lie on one similarity p = a q + b."""
    keep, apart = np.ones(len(p), bool), wide / APART
    places = lambda z: len(np.unique(np.round(z.real / apart) + 1j * np.round(z.imag / apart)))
    for turn in range(rounds):
        x, y = p[keep], q[keep]
        spread = y - y.mean()
        if not (norm := (np.abs(spread) ** 2).sum()):
            return False
        a = (spread.conj() * x).sum() / norm
        off = np.abs(p - a * q - (x.mean() - a * y.mean()))
        near = off <= max(wide / TIGHT, 1.2 * np.median(off[keep]) if turn + 1 < rounds else 0)
        if min(places(p[near]), places(a * q[near])) < least:
            return False
        keep = near
    return 0.3 < abs(a) < 3.5


def packed(ids: np.ndarray, rows: np.ndarray) -> bytes:
    """Corners (spot and words) of images, with each image's id and number of corners once where they follow each other."""
    start = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return b"".join(x.astype(np.int64, copy=False).tobytes() for x in (np.array([len(start)]), ids[start], np.diff(start, append=len(ids)), rows))


def unpacked(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, spots and words of all corners of ``packed`` blobs by id, each copied once."""
    runs, ids, sizes = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in blobs:
        numbers = np.frombuffer(blob, np.int64)
        n = int(numbers[0])
        rows, size = numbers[1 + 2 * n :].reshape(-1, 5), numbers[1 + n : 1 + 2 * n]
        ids.append(numbers[1 : 1 + n])
        sizes.append(size)
        ends = np.cumsum(size).tolist()
        runs += [(rows, a, b) for a, b in zip([0, *ends], ends, strict=False)]
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    by = np.argsort(ids, kind="stable")
    spot, words, at = np.empty(int(sizes.sum()), np.int64), np.empty((int(sizes.sum()), 4), np.int64), 0
    for k in by.tolist():
        rows, a, b = runs[k]
        spot[at : at + b - a], words[at : at + b - a] = rows[a:b, 0], rows[a:b, 1:]
        at += b - a
    return np.repeat(ids[by], sizes[by]), spot, words.view(np.uint64)


def linked(points: DataFrame, reach: int, least: int, crowd: int = 64, block: int = 1_400_000, few: int = 8) -> DataFrame:
    """Pairs of images (a, b), a > b, of which ``least`` corners match and agree on a transform.

    Every two corners with an equal 32-bit piece are compared.  Corners are dealt into blocks
    of images, and each pair of blocks meets in a task of its own that compares and votes
    there: only links leave it, however many corners look alike.  With up to ``few`` blocks that
    moves less than a table for each piece would.  With more, only corners of buckets with over
    ``crowd`` go that way; in smaller buckets they meet in a join on the piece.  The links are the same.
    """
    spark = points.sparkSession
    total = points.count()
    none = spark.createDataFrame([], "a long, p long, b long, q long")
    pairs = none
    if total > few * block:
        points = materialize(points)
        entries = points.select("id", "spot", *WORDS, F.explode(F.array(*[piece(i, j) for i in range(4) for j in (0, 1)])).alias("key"))
        sizes = materialize(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
        small = entries.join(sizes.where(F.col("n") <= crowd).select("key"), "key")
        other = small.select("key", *[F.col(c).alias(f"o_{c}") for c in ("id", "spot", *WORDS)])
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o_{w}"))) for w in WORDS), F.lit(0))
        pairs = small.join(other, "key").where((F.col("id") > F.col("o_id")) & (apart <= reach))
        pairs = materialize(pairs.select(F.col("id").alias("a"), F.col("spot").alias("p"), F.col("o_id").alias("b"), F.col("o_spot").alias("q")))
        many = entries.select("id", "spot", "key").join(sizes.where(F.col("n") > crowd).select("key"), "key", "left_semi").select("id", "spot").distinct()
        many = materialize(points.join(many, ["id", "spot"], "left_semi"))
        total = many.count()
    else:
        many = points
    n = max(1, -(-total // block))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    cell = lambda x, y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, ids = (batch.column(c).to_numpy() for c in ("mine", "id"))
            rows = np.stack([batch.column(c).to_numpy() for c in ("spot", *WORDS)], axis=1)
            for k in np.unique(mine).tolist():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([packed(ids[mine == k], rows[mine == k])], pa.binary())], ["mine", "blob"])

    corners = many.select("id", "spot", *WORDS, part("id").alias("mine")).mapInArrow(pack, "mine int, blob binary")
    corners = corners.select("*", F.explode(F.array(*[F.lit(x) for x in range(n)])).alias("x"))
    corners = corners.select("mine", "blob", cell(F.col("mine"), F.col("x")).alias("c")).select("mine", "blob", "c.i", "c.j")
    pairs = pairs.withColumns({"mine": part("a"), "c": cell(part("a"), part("b"))}).select("a", "p", "b", "q", "mine", "c.i", "c.j")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        sides = []
        for k in (i, j):
            owners = left["mine"].to_pylist()
            sides.append(unpacked([left["blob"][n].as_buffer() for n, m in enumerate(owners) if m == k]))
        trim()
        known, owner = np.stack([right.column(c).to_numpy() for c in ("a", "p", "b", "q")]), right.column("mine").to_numpy()
        known[:, owner != i] = known[:, owner != i][[2, 3, 0, 1]]
        known = known[:, np.argsort(known[0], kind="stable")]
        found = np.concatenate([agreeing(m, least) for m in meet(*sides, known, reach, least, i == j)], axis=1)
        del sides
        trim()
        return pa.table({"a": found.max(axis=0), "b": found.min(axis=0)})

    return corners.groupBy("i", "j").cogroup(pairs.groupBy("i", "j")).applyInArrow(run, "a long, b long").distinct()


def find_copies(media: DataFrame, reach: int = 32, consensus: int = 5, **blocks) -> DataFrame:
    """One row per row of ``media (media_id, image)``: class_id, the smallest media_id of its copies, links, corners, and whether it could be read.

    reach: of the 256 bits of a descriptor, those that may differ between matching corners,
    which also have a 32-bit piece in common.  consensus: corners that must lie on one
    similarity transform.  blocks: see ``linked``.

    Identical images are one image from their content's hash on, however many there are.
    Null, empty or unreadable images (other formats than binary PGM and plain 8-bit PNG) are
    classes of their own content with ``decoded`` false; images without a telling corner are too.
    Very large images have more corners and more scales.  Rows without a media_id get the class
    of their content's smallest id, null if none.  Repeated rows give one row; ties go to the
    smaller id; an empty table gives an empty one; other columns are ignored.
    """
    found = materialize(descriptors(media))
    images = materialize(found.groupBy("content", "media_id").agg((F.count("spot") / F.count_if(F.col("spot").isNull())).cast("long").alias("n_corners"), F.bool_and("decoded").alias("decoded")))
    heads = found.where("spot is null").select("content", "media_id", "row")
    classes = heads.groupBy("content").agg(F.min(F.expr("if(media_id is null, null, struct(media_id, row))")).alias("first")).select("content", F.col("first.media_id").alias("id"), F.col("first.row").alias("first"))
    again = materialize(heads.join(classes, "content").where(~F.col("row").eqNullSafe(F.col("first"))).select("row"))  # rows of which an equal one goes on, often few
    points = found.where("spot is not null").join(again, "row", "left_anti").select(F.col("media_id").alias("id"), "spot", *WORDS)
    links = materialize(linked(points, reach, consensus, **blocks))
    roots = components(links)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = classes.join(roots, classes["id"] == roots["node"], "left").select("content", "id", F.coalesce("root", "id").alias("class_id"))
    classes = classes.join(degree, "id", "left").select("content", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return images.join(classes, "content").select("media_id", "class_id", "n_links", "n_corners", "decoded")


def render(vector: list[float] | None, size: int = 112) -> np.ndarray:
    """A picture made from a vector: shaded rectangles whose places and shades it seeds."""
    raw = np.asarray(vector or [], np.float32).tobytes()
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(raw).digest()[:8], "big"))
    y, x = np.mgrid[0:size, 0:size]
    out = 100 + 40 * np.sin(x / rng.uniform(8, 30) + y / rng.uniform(8, 30))
    for _ in range(36):
        h, w = rng.integers(5, 30, 2)
        top, left = rng.integers(0, size - 5, 2)
        out[top : top + h, left : left + w] = rng.integers(0, 256)
    return np.clip(out, 0, 255).astype(np.uint8)


def edited(image: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """A crop, a change of brightness and contrast, a quarter turn, or a crop with noise."""
    rng = np.random.default_rng(seed)
    size = image.shape[0]
    a, b = rng.integers(0, size // 5, 2)
    crop = image[a : a + 4 * size // 5, b : b + 4 * size // 5]
    if kind == 0:
        return crop
    if kind == 1:
        return np.clip(image * 0.7 + 30, 0, 255).astype(np.uint8)
    if kind == 2:
        return np.rot90(image).copy()
    return np.clip(crop + rng.normal(0, 2, crop.shape), 0, 255).astype(np.uint8)


def pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def pictures(vectors: DataFrame, every: int = 10) -> DataFrame:
    """A media table made from ``vectors (vec_id, embedding)``: a picture each, with media_id 2 * vec_id,
    and of every ``every``-th an edited copy, with media_id 2 * vec_id + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = [], []
            for key, vector in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                image = render(vector)
                ids.append(None if key is None else 2 * key)
                blobs.append(pgm(image))
                if key is not None and key % every == 0:
                    ids.append(2 * key + 1)
                    blobs.append(pgm(edited(image, key // every % 4, key)))
                if len(ids) >= 500:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["media_id", "image"])
                    ids, blobs = [], []
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["media_id", "image"])

    return only(vectors, "vec_id", "embedding").mapInArrow(run, "media_id long, image binary")

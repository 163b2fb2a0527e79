"""Operator 6: removal of repeated strings by a distributed merge sort of suffixes.

A suffix is sorted by its first bytes, as far as it may repeat; hashes only say which may:

1. Every window of ``length`` bytes has an anchor, its k-gram of least hash, and equal
   windows have equal anchors at equal places.  Windows in a row with the same anchor form
   a stretch.  A stretch whose anchor is nowhere else cannot repeat and is left out; one
   that has a likeness is sorted whole, as one suffix.
2. Where one anchor stands in different surroundings, its stretches are cut into pieces of
   up to eight windows that share a core of ``length - 7`` bytes.  Again pieces whose core is
   nowhere else are left out, pieces with a likeness are sorted whole, and of pieces with
   different surroundings every window is sorted.
3. Tasks sort their suffixes into front-coded runs, runs are exchanged by ranges of strings,
   and a loser tree merges them.  It knows how many bytes each head shares with the last
   string that came out, and compares only what follows.  Of equal strings all but the
   earliest are repeats; nothing else decides what is removed.

Tasks send every string once, and each run holds it once, so what one hot string, anchor or
core sends is bounded by the number of tasks.  Two different strings with one 64-bit hash
would show in the merge, which then fails; another ``seed`` mends that.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, row_filter, slices, trim, unused, with_row_id

U = np.uint64
SEGMENT = 1 << 20
#: Where a row without a doc_id stands in the order of documents.
NO_ID = np.iinfo(np.int64).max
BASE = 0x9E3779B97F4A7C15
CORE = 8
#: Ranges that splitters tell apart; further ones divide a range by a hash of the string.
RANGES = 4096
#: Suffixes of one run, and bytes of text that a worker holds at a time.
RUN, SLICE = 1 << 17, 8 << 20
MEETING = "two different strings have the same hash; pass another seed"


@lru_cache(maxsize=1)
def press() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


@lru_cache
def header(n: int) -> struct.Struct:
    """Of each of ``n`` fields its kind, its columns if it has two dimensions, and its length or value."""
    return struct.Struct("<q" + "cxHxxxxq" * n)


def packed(*fields) -> bytes:
    """Arrays, bytes and numbers as one blob.  Blobs grow with the square of the parts, so they are cheap to make."""
    head, body = [len(fields)], []
    for x in fields:
        if isinstance(x, np.ndarray):
            head += (x.dtype.char.encode(), x.shape[1] if x.ndim > 1 else 0, len(x))
            x = x.tobytes()
        elif isinstance(x, bytes):
            head += (b"$", 0, len(x))
        else:
            head += (b"#", 0, x)
            continue
        body += (x, bytes(-len(x) % 8))
    return press()[0].compress(b"".join((header(len(fields)).pack(*head), *body)))


def unpacked(blob: bytes) -> tuple:
    """The fields of a blob; arrays can't be written to."""
    raw = press()[1].decompress(blob)
    form = header(int.from_bytes(raw[:8], "little"))
    head, at, out = form.unpack_from(raw), form.size, []
    for kind, wide, n in zip(head[1::3], head[2::3], head[3::3], strict=True):
        if kind == b"#":
            out.append(n)
            continue
        if kind == b"$":
            out.append(raw[at : at + n])
            at += n + -n % 8
            continue
        x = np.frombuffer(raw, kind.decode(), n * (wide or 1), at)
        at += x.nbytes + -x.nbytes % 8
        out.append(x.reshape(n, wide) if wide else x)
    return tuple(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    return h


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(SEGMENT + 1, b, U)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U)


def prefix_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(byte_values(seed)[data] * powers()[0][: len(data)], out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings from each start to each end, whatever their place."""
    return (sums[end] - sums[start]) * powers()[1][start]


def stretches(data: np.ndarray, length: int, k: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of a text of at most a segment: first window, windows, bytes up to the anchor, hash of the anchor, hash of the stretch."""
    n = len(data) - length + 1
    sums, width = prefix_hashes(data, seed), length - k + 1
    grams = mix((sums[k:] - sums[:-k]) * powers()[1][: len(data) - k + 1])
    least = (grams & U(((1 << 64) - 1) ^ (SEGMENT - 1))) | np.arange(len(grams), dtype=U)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if rest := width - step:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & U(SEGMENT - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(first, append=n)
    anchor = anchor[first]
    shape = (anchor - first).astype(U) * U(0xD6E8FEB86659FD93) + count.astype(U) * U(0xA0761D6478BD642F)
    return first, count, anchor - first, grams[anchor], mix(between(sums, first, first + count - 1 + length) + shape)


def segments(data: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a long text that together hold every window once."""
    for at in range(0, max(1, len(data) - length + 1), SEGMENT - length + 1):
        yield at, data[at : at + SEGMENT]


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys starts."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return new


def groups_of(keys: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each value of ``keys``."""
    order = np.argsort(keys, kind="stable")
    yield from np.split(order, np.flatnonzero(firsts(keys[order]))[1:]) if len(order) else []


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted values of ``keys``, and which of them each is."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = firsts(ordered)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], at


def part_of(rid: np.ndarray, parts: int) -> np.ndarray:
    return (mix(rid.astype(np.int64).view(U) + U(0x632BE59BD9B4E019)) % U(parts)).astype(np.int64)


def ranks(doc: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """Each document's place in the order of documents; the same for a document that comes twice."""
    order = np.lexsort((rid, doc))
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(firsts(doc[order], rid[order]))
    return out


def replies(parts: int, doc: np.ndarray, rid: np.ndarray, owner: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Rows for the parts that hold the documents: ``owner`` points into doc and rid."""
    where = part_of(rid, parts)[owner]
    for rows in groups_of(where):
        known, at = distinct(owner[rows])
        yield int(where[rows[0]]), packed(doc[known], rid[known], at.astype(np.int32), *[c[rows] for c in columns])


def joined(rows: list[bytes], *extra: int) -> tuple[np.ndarray, ...]:
    """Blobs of ``replies`` as one: doc, rid, owner and the columns."""
    got = [unpacked(b) for b in rows]
    base = np.cumsum([0, *[len(g[0]) for g in got]])
    doc, rid = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    owner = np.concatenate([g[2].astype(np.int64) + b for g, b in zip(got, base, strict=False)])
    return doc, rid, owner, *[np.concatenate([g[i] for g in got]) for i in range(3, len(got[0]))]


def blobs(rows: list[tuple[int, bytes]], name: str) -> pa.Table:
    return pa.table({name: pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


#: What is known of a string: it has a likeness, an earlier one, others with its anchor or core.
SAME, EXPECT, OPEN = 1, 2, 4
#: How a task sends a string: alone with its anchor, with others, as one of two witnesses of others, as its own repeat.
SINGLE, MANY, WITNESS, AGAIN = 0, 1, 2, 3


def _local(doc, rid, owner, first, count, ahead, coarse, fine, buckets: int) -> Iterator[tuple[int, bytes]]:
    """What one task sends of its strings: each once, by the hash ``coarse`` of its anchor or core.

    Where the task has several strings with one anchor, they go by their own hash ``fine``
    instead, and two witnesses stand for them.
    """
    group = mix(coarse ^ (fine * U(BASE)))
    order = np.lexsort((first, ranks(doc, rid)[owner], group))
    new = np.empty(len(order), bool)
    new[order] = firsts(group[order], coarse[order], fine[order])
    twice = np.zeros(len(order), bool)
    twice[order[:-1]] = new[order[:-1]] & ~new[order[1:]]
    kind = np.where(new, SINGLE, AGAIN).astype(np.uint8)
    lead = np.flatnonzero(new)
    lead = lead[np.argsort(coarse[lead], kind="stable")]
    start = firsts(coarse[lead])
    number = np.cumsum(start) - 1
    many = np.bincount(number)[number] > 1 if len(lead) else np.zeros(0, bool)
    place = np.arange(len(lead)) - np.flatnonzero(start)[number]
    kind[lead[many]] = MANY
    witness = lead[many & (place < 2)]
    rows = np.concatenate((np.arange(len(kind)), witness))
    kind = np.concatenate((kind, np.full(len(witness), WITNESS, np.uint8)))
    where = np.where(kind == MANY, mix(fine[rows]), coarse[rows] >> U(8)) % U(buckets)
    for part in groups_of(where):
        r, kd = rows[part], kind[part]
        known, at = distinct(owner[r])
        keyed = r[kd != AGAIN]
        short = coarse[keyed].view(np.uint8).reshape(-1, 8)[:, 1:7]  # six bytes: a chance meeting only opens a string
        yield int(where[part[0]]), packed(doc[known], rid[known], at.astype(np.int32), first[r].astype(np.int32), count[r].astype(np.uint8), ahead[r].astype(np.uint8), kd, twice[keyed], short.copy(), fine[keyed])


def _settle(table: pa.Table, parts: int) -> Iterator[tuple[int, bytes]]:
    """In a bucket: which strings have a likeness, and which anchors or cores stand in different ones."""
    got = joined(table["blob"].to_pylist())
    doc, rid, owner, first, count, ahead, kind, twice, short, fine = got
    state = np.where(kind == AGAIN, SAME | EXPECT, 0).astype(np.uint8)
    rows = np.flatnonzero(kind != AGAIN)
    if len(rows):
        raw = np.zeros((len(rows), 8), np.uint8)
        raw[:, :6] = short
        coarse, how = raw.view(U).ravel(), kind[rows]
        # Those that were sent here by their own hash meet only each other; a witness is like none.
        coarse = np.where(how == MANY, ~coarse, coarse)
        fine = np.where(how == WITNESS, ~fine, fine)
        at = (ranks(doc, rid)[owner[rows]].astype(U) << U(32)) | first[rows].astype(U)
        group = mix(coarse ^ (fine * U(BASE)))
        order = np.lexsort((at, group))
        new = np.empty(len(order), bool)
        new[order] = firsts(group[order], coarse[order], fine[order])
        more = np.zeros(len(order), bool)
        more[order[:-1]] = ~new[order[1:]]
        state[rows[~new]] = SAME | EXPECT
        state[rows[new & (more | twice)]] |= SAME
        lead = np.flatnonzero(new)
        lead = lead[np.argsort(coarse[lead], kind="stable")]
        number = np.cumsum(firsts(coarse[lead])) - 1
        several = np.bincount(number)[number] > 1
        state[rows[lead[several]]] |= OPEN
        state[rows[new & (how == MANY)]] |= OPEN
        state[kind == WITNESS] = 0
    told = np.flatnonzero(state)
    yield from replies(parts, doc, rid, owner[told], first[told], count[told], ahead[told], state[told])


def _contexts(texts: dict, told: tuple, length: int) -> Iterator[bytes]:
    """The bytes of the told stretches of one part's documents, each byte once, in blobs of at most a segment.

    A blob: doc, rid, owner of each stretch, first, count, ahead, state, its place in the text, the text.
    """
    doc, rid, owner, first, count, ahead, state = told
    first, count = first.astype(np.int64), count.astype(np.int64)
    rows, pieces, held = [], [], 0

    def blob() -> bytes:
        who, *numbers = (np.concatenate(c) for c in zip(*rows, strict=True))
        used, at = distinct(who)
        return packed(doc[used], rid[used], at.astype(np.int32), *numbers, b"".join(pieces))

    half = SEGMENT // 2
    rank = ranks(doc, rid)
    order = np.lexsort((first, rank[owner]))
    new = firsts(rank[owner[order]], first[order] // half)
    for chunk in np.split(order, np.flatnonzero(new)[1:]) if len(order) else []:
        i = int(owner[chunk[0]])
        text = texts[int(doc[i]), int(rid[i])]
        start, end = first[chunk], first[chunk] + count[chunk] - 1 + length
        upto = np.maximum.accumulate(end)
        lead = np.flatnonzero(np.concatenate(([True], start[1:] > upto[:-1])))
        low, high = start[lead], np.append(upto[lead[1:] - 1], upto[-1])
        size = int((high - low).sum())
        if rows and held + size > SEGMENT:
            yield blob()
            rows, pieces, held = [], [], 0
        which = np.cumsum(np.isin(np.arange(len(chunk)), lead)) - 1
        begin = held + (np.cumsum(high - low) - (high - low))[which] + start - low[which]
        rows.append((owner[chunk], first[chunk], count[chunk], ahead[chunk].astype(np.int64), state[chunk], begin))
        pieces += [text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        held += size
    if rows:
        yield blob()


def _pieces(blob: bytes, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of a blob's open stretches: doc, rid, owner, first, count, ahead (zero), hash of the core, hash of the piece.

    A piece has the windows that start 8q to 8q + 7 bytes before the anchor; its core is what they all hold.
    """
    doc, rid, owner, first, count, ahead, state, begin, text = unpacked(blob)
    open_ = np.flatnonzero((state & OPEN) > 0)
    owner, first, count, ahead, begin = (c[open_] for c in (owner, first, count, ahead, begin))
    low, high = (ahead - count + 1) // CORE, ahead // CORE
    many = high - low + 1
    which = np.repeat(np.arange(len(count)), many)
    q = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    last = ahead[which] - CORE * q
    lo, hi = np.maximum(0, last - CORE + 1), np.minimum(count[which] - 1, last)
    place = begin[which]
    sums = prefix_hashes(np.frombuffer(text, np.uint8), seed)
    core = mix(between(sums, place + last, place + last - CORE + 1 + length) + q.astype(U) * U(BASE))
    piece = mix(between(sums, place + lo, place + hi + length) + (q * 64 + (last - hi) * 8 + hi - lo).astype(U) * U(0xD6E8FEB86659FD93))
    return doc, rid, owner[which].astype(np.int64), first[which] + lo, hi - lo + 1, np.zeros(len(which), np.int64), core, piece


def _items(contexts: list[bytes], told: list[bytes], length: int, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The suffixes of one part to sort, blob by blob: doc, rid, owner, first window, windows, whether an earlier one is expected, strings.

    A string is as many bytes as its windows have, zeros up to a fixed width, and the number of windows.
    """
    pieces: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
    if told:
        doc, rid, owner, first, count, _, state = joined(told)
        key = ranks(doc, rid)[owner]
        for rows in groups_of(key):
            i = owner[rows[0]]
            order = rows[np.argsort(first[rows], kind="stable")]
            pieces.setdefault((int(doc[i]), int(rid[i])), []).append((first[order].astype(np.int64), count[order].astype(np.int64), state[order]))
    for blob in contexts:
        doc, rid, owner, first, count, _, state, begin, text = unpacked(blob)
        data = np.concatenate((np.frombuffer(text, np.uint8), np.zeros(width, np.uint8)))
        same = (state & SAME) > 0
        found = [(owner[same], first[same], count[same], begin[same], (state[same] & EXPECT) > 0)]
        if pieces:
            for rows in groups_of(np.where((state & OPEN) > 0, owner, -1)):
                if not state[rows[0]] & OPEN:
                    continue
                rows = rows[np.argsort(first[rows], kind="stable")]
                i = int(owner[rows[0]])
                for f, n, st in pieces.get((int(doc[i]), int(rid[i])), ()):
                    at = np.searchsorted(first[rows], f, "right") - 1
                    inside = (at >= 0) & (f < first[rows][at] + count[rows][at])
                    f, n, st = f[inside], n[inside], st[inside]
                    place = begin[rows][at[inside]] + f - first[rows][at[inside]]
                    alike = (st & SAME) > 0
                    found.append((np.full(alike.sum(), i), f[alike], n[alike], place[alike], (st[alike] & EXPECT) > 0))
                    wide = (st & OPEN) > 0
                    step = np.repeat(np.cumsum(n[wide]) - n[wide], n[wide])
                    step = np.arange(len(step)) - step
                    found.append((np.full(len(step), i), np.repeat(f[wide], n[wide]) + step, np.ones(len(step), np.int64), np.repeat(place[wide], n[wide]) + step, np.zeros(len(step), bool)))
        who, first, count, begin, expected = (np.concatenate(c) for c in zip(*found, strict=True))
        for at in range(0, len(who), RUN):
            cut = slice(at, at + RUN)
            strings = np.lib.stride_tricks.sliding_window_view(data, width)[begin[cut]]
            strings[np.arange(width) >= (count[cut] + length - 1)[:, None]] = 0
            strings[:, -1] = count[cut]
            yield doc, rid, who[cut], first[cut], count[cut], expected[cut], strings


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each string shares with the one before; none for the first."""
    differs = rows[1:] != rows[:-1]
    return np.concatenate(([0], np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1]))).astype(np.int64)


def strings_of(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def spread(rows: np.ndarray, splitters: np.ndarray, subs: int) -> np.ndarray:
    """The range of each sorted string: between which splitters it lies, and a hash where ranges are divided further."""
    where = np.searchsorted(splitters, strings_of(rows)).astype(np.int64)
    if subs > 1:
        padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
        padded[:, : rows.shape[1]] = rows
        h = np.zeros(len(rows), U)
        for column in padded.view(U).T:
            h = mix(h ^ column)
        where = where * subs + (h % U(subs)).astype(np.int64)
    return where


def _run(items: list[tuple[np.ndarray, ...]], splitters: np.ndarray, subs: int, part: int) -> Iterator[tuple[int, bytes]]:
    """A task's suffixes, sorted, front-coded and cut by ranges; its own repeats go along as found, under a range below zero."""
    base = np.cumsum([0, *[len(i[0]) for i in items]])
    doc, rid = (np.concatenate([i[j] for i in items]) for j in (0, 1))
    owner = np.concatenate([i[2].astype(np.int64) + b for i, b in zip(items, base, strict=False)])
    first, count, expected, rows = (np.concatenate([i[j] for i in items]) for j in (3, 4, 5, 6))
    items.clear()
    key = (ranks(doc, rid)[owner] << 32) | first
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(strings_of(rows[order]), kind="stable")]
    owner, key, first, count, expected, rows = (c[order] for c in (owner, key, first, count, expected, rows))
    new = common_prefixes(rows) < rows.shape[1]
    once = new | firsts(key)  # one place may be sent as a stretch and as a piece or window of it
    if len(again := np.flatnonzero(~new & once)):
        yield -1 - part, packed(part, *_found(doc, rid, owner[again], first[again], count[again]))
    owner, first, count, expected, rows = (c[new] for c in (owner, first, count, expected, rows))
    where = spread(rows, splitters, subs)
    common = common_prefixes(rows)
    for at in groups_of(where):
        if subs > 1:
            shared = common_prefixes(rows[at])
        else:  # a range is a stretch of the sorted strings
            shared = common[at]
            shared[0] = 0
        tails = rows[at][np.arange(rows.shape[1]) >= shared[:, None]]
        used, who = distinct(owner[at])
        yield int(where[at[0]]), packed(part, doc[used], rid[used], who.astype(np.int32), first[at], count[at].astype(np.uint8), expected[at], shared.astype(np.int16), tails.tobytes())


def _found(doc, rid, owner, first, count) -> tuple[np.ndarray, ...]:
    """Repeats as rows for their part: doc, rid, owner, first window, windows."""
    used, who = distinct(owner)
    return doc[used], rid[used], who.astype(np.int32), first.astype(np.int32), count.astype(np.uint8)


def decoded(shared: list[int], tails: bytes, width: int) -> list[bytes]:
    """The strings of a front-coded run."""
    out, last, at = [], b"", 0
    for n in shared:
        end = at + width - n
        last = last[:n] + tails[at:end]
        out.append(last)
        at = end
    return out


def merge(runs: list[tuple[list[bytes], list[int]]], width: int) -> Iterator[tuple[int, int, bool]]:
    """Merge sorted runs of (strings, bytes shared with the one before): ``(run, place, same as the last)``.

    A loser tree.  Every head is known to share so many bytes with the string that came out
    last: of two heads the one that shares more comes first, and only heads that share as
    many are compared, from there on.
    """
    k = len(runs)
    place, common = [0] * k, [0] * k
    heads = [strings[0] if strings else None for strings, _ in runs]
    for i in range(k):
        if heads[i] is None:
            common[i] = -1

    def meet(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two heads; the loser then knows what it shares with the winner."""
        if common[i] != common[j]:
            return (i, j) if common[i] > common[j] else (j, i)
        h = common[i]
        if h < 0:
            return i, j
        a, b = heads[i], heads[j]
        x = int.from_bytes(a[h:], "big") ^ int.from_bytes(b[h:], "big")
        n = width - (x.bit_length() + 7) // 8
        if x and a[n] > b[n]:
            i, j = j, i
        common[j] = n
        return i, j

    tree, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], tree[node] = meet(winners[2 * node], winners[2 * node + 1])
    w = winners[1] if k else -1
    while k and common[w] >= 0:
        at = place[w]
        yield w, at, common[w] == width
        at += 1
        place[w] = at
        strings, shared = runs[w]
        if at < len(strings):
            heads[w], common[w] = strings[at], shared[at]
        else:
            heads[w], common[w] = None, -1
        node = (w + k) >> 1
        while node:
            o = tree[node]
            c, d = common[w], common[o]
            if c < d:
                tree[node], w = w, o
            elif c == d and c >= 0:
                w, tree[node] = meet(w, o)
            node >>= 1


def _merged(table: pa.Table, width: int) -> Iterator[tuple[int, bytes]]:
    """In a range: the repeats among the suffixes of all tasks."""
    got = [unpacked(b) for b in table["blob"].to_pylist()]
    if table["range"][0].as_py() < 0:  # what tasks have found among their own
        yield from ((g[0], packed(*g[1:])) for g in got)
        return
    runs = [(decoded(g[7].tolist(), g[8], width), g[7].tolist()) for g in got]
    rank = np.split(ranks(*[np.concatenate([g[i] for g in got]) for i in (1, 2)]), np.cumsum([len(g[1]) for g in got])[:-1])
    keys = [((r[g[3]] << 32) | g[4]).tolist() for r, g in zip(rank, got, strict=True)]
    found: list[list[int]] = [[] for _ in got]
    run, at = -1, -1
    for w, i, same in merge(runs, width):
        if same:
            if keys[w][i] > keys[run][at]:
                found[w].append(i)
                continue
            if keys[w][i] == keys[run][at]:
                continue
            found[run].append(at)
        elif run >= 0 and got[run][6][at]:
            raise RuntimeError(MEETING)
        run, at = w, i
    if run >= 0 and got[run][6][at]:
        raise RuntimeError(MEETING)
    for (part, doc, rid, owner, first, count, *_), rows in zip(got, found, strict=True):
        if rows:
            rows = np.array(rows, np.int64)
            yield part, packed(*_found(doc, rid, owner[rows], first[rows], count[rows]))


def _each(fn: Callable[[pa.Table], Iterator[tuple]], *names: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = list(fn(table))
        trim()
        kinds = [pa.binary() if n == "blob" else pa.int64() for n in names]
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=list(names))

    return run


def _compressed(docs: DataFrame, parts: int, wanted) -> DataFrame:
    """The rows of ``docs`` that ``wanted`` (a row filter) may hold, with compressed texts and the part that each belongs to."""
    fields = [T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField("__part", T.LongType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in slices(batches, "text", 2000, SLICE):
            batch = batch.filter(pa.array(wanted.value.has(batch.column("__rid").to_numpy(zero_copy_only=False))))
            texts = pa.array([None if t is None else press.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            columns = [texts if n == "text" else batch.column(n) for n in names[:-1]]
            yield pa.record_batch([*columns, pa.array(part_of(batch.column("__rid").to_numpy(zero_copy_only=False), parts))], names)

    return docs.mapInArrow(run, schema)


def _keys(table: pa.Table) -> list[tuple[int, int]]:
    return list(zip(table["doc_id"].cast(pa.int64()).fill_null(NO_ID).to_pylist(), table["__rid"].to_pylist(), strict=True))


def _named(blob: bytes) -> np.ndarray:
    return unpacked(blob)[1]


def repeats(docs: DataFrame, length: int, k: int, parts: int, rows: int, seed: int) -> DataFrame:
    """``(part, blob)``: the windows of ``docs`` (doc_id, text, __rid) that are repeats, by part."""
    by_bucket, by_part = "bucket long, blob binary", "part long, blob binary"

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 30, SLICE):
            doc = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            rid = batch.column("__rid").to_numpy(zero_copy_only=False)
            got, owner = [], []
            for i, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if t and len(t) >= length:
                    for at, piece in segments(np.frombuffer(t, np.uint8), length):
                        first, *rest = stretches(piece, length, k, seed)
                        got.append((first + at, *rest))
                        owner.append(np.full(len(first), i))
            if got:
                columns = [np.concatenate(c) for c in zip(*got, strict=True)]
                got.clear()
                yield from blobs(list(_local(doc, rid, np.concatenate(owner), *columns, parts)), "bucket").to_batches()

    settle = _each(lambda t: _settle(t, parts), "part", "blob")
    told = materialize(docs.mapInArrow(start, by_bucket).groupBy("bucket").applyInArrow(settle, by_part))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return blobs([], "part")
        known = joined(right["blob"].to_pylist())
        plain = zstandard.ZstdDecompressor()
        named = set(zip(known[0].tolist(), known[1].tolist(), strict=True))
        texts = {key: plain.decompress(z.as_py()) for key, z in zip(_keys(left), left["text"], strict=True) if key in named}
        part = right["part"][0].as_py()
        out = blobs([(part, b) for b in _contexts(texts, known, length)], "part")
        trim()
        return out

    texts = _compressed(docs, parts, row_filter(told, _named, rows))
    contexts = materialize(texts.groupBy("__part").cogroup(told.groupBy("part")).applyInArrow(cut, by_part))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, size = [], 0
            for i, blob in enumerate(every := batch.column("blob").to_pylist()):
                got.append(_pieces(blob, length, seed))
                size += len(got[-1][2])
                if size and (size > RUN or i + 1 == len(every)):
                    base = np.cumsum([0, *[len(g[0]) for g in got]])
                    doc, rid = (np.concatenate([g[j] for g in got]) for j in (0, 1))
                    owner = np.concatenate([g[2] + b for g, b in zip(got, base, strict=False)])
                    columns = [np.concatenate([g[j] for g in got]) for j in range(3, 8)]
                    got, size = [], 0
                    yield from blobs(list(_local(doc, rid, owner, *columns, parts)), "bucket").to_batches()
            trim()

    shared = contexts.mapInArrow(pieces, by_bucket).groupBy("bucket").applyInArrow(settle, by_part)
    ranges, width = min(parts, RANGES), 2 * length - k + 1
    subs = -(-parts // ranges)
    splitters = docs.sparkSession.sparkContext.broadcast(_splitters(contexts, ranges, length))

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return blobs([], "range")
        part, rows, held, size = left["part"][0].as_py(), [], [], 0
        for item in _items(left["blob"].to_pylist(), right["blob"].to_pylist(), length, width):
            if held and size + len(item[2]) > RUN:
                rows += _run(held, splitters.value, subs, part)
                held, size = [], 0
            held.append(item)
            size += len(item[2])
        if size:
            rows += _run(held, splitters.value, subs, part)
        trim()
        return blobs(rows, "range")

    runs = contexts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(sort, "range long, blob binary")
    return runs.groupBy("range").applyInArrow(_each(lambda t: _merged(t, width), "part", "blob"), by_part)


def _splitters(contexts: DataFrame, ranges: int, length: int, each: int = 64) -> np.ndarray:
    """At most ``ranges - 1`` strings that cut a sample, 16 for each range, into even ranges."""
    share = min(1.0, 16 * ranges / (each * max(1, contexts.count())))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blob in batch.column("blob").to_pylist():
                *_, begin, text = unpacked(blob)
                chosen = begin[np.linspace(0, len(begin) - 1, each).astype(int)].tolist()
                out += [text[i : i + length] for i in chosen]
            yield pa.record_batch([pa.array(out, pa.binary())], ["s"])

    chosen = contexts.where(F.pmod(F.xxhash64("part", F.crc32("blob")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    found = sorted(bytes(r.s) for r in chosen.select("blob").mapInArrow(pick, "s binary").limit(64 * ranges + each).collect())
    cuts = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    return np.array(sorted(set(cuts)), f"S{length}")


def _kept(text: bytes, found: list[tuple[np.ndarray, np.ndarray]], length: int) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and what is left, where windows (first, count) are repeats."""
    edge = np.zeros(len(text) + 1, np.int32)
    for first, count in found:
        np.add.at(edge, first, 1)
        np.add.at(edge, first + count + length - 1, -1)
    cover = np.cumsum(edge[:-1]) > 0
    spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
    return int(cover.sum()), spans, np.frombuffer(text, np.uint8)[~cover].tobytes()


def strip_repeats(docs: DataFrame, length: int = 100, k: int = 36, part_bytes: int = 8 << 20, keep_text: bool = False, seed: int = 7) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256; with ``keep_text`` also
    ``kept``, what is left (bytes of characters cut in two are left out), and ``row``, a
    struct of all columns of ``docs`` but text, so that no name can clash.  Earlier is:
    smaller doc_id, then a fixed order of rows with equal ids, then the place in the text;
    rows without a doc_id come last.

    Null and empty texts have no bytes; a text of fewer than ``length`` bytes keeps all; very
    long texts are hashed in segments that overlap, so no window is lost.  Of repeated rows
    one keeps its text.  An empty table gives an empty one.  Extra columns take no part.
    """
    if not 0 < length - k + 1 <= 255:
        raise ValueError("an anchor of k bytes must fit into a window in 1 to 255 places")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    parts = max(1, -(-(size["bytes"] or 0) // part_bytes))
    mine = unused(docs, "__rid")
    rows = with_row_id(docs, mine)
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if keep_text else []
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(mine).alias("__rid"), *others)
    found = materialize(repeats(rows.select("doc_id", "text", "__rid"), length, k, parts, size["rows"], seed))
    touched = row_filter(found, _named, size["rows"])
    carried = [f for f in rows.schema if f.name in ("doc_id", "row")]
    fields = [*carried, *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField("kept", T.StringType()))

    def made(columns: list, texts: Iterator[tuple[bytes | None, list]]) -> dict[str, pa.Array]:
        out = []
        for text, marks in texts:
            gone, spans, kept = _kept(text, marks, length) if marks else (0, 0, text or b"")
            row = (len(text or b""), gone, spans, hashlib.sha256(kept).hexdigest())
            out.append((*row, None if text is None else kept.decode("utf-8", "ignore")) if keep_text else row)
        kinds = [pa.int64()] * 3 + [pa.string()] * (2 if keep_text else 1)
        new = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
        return dict(zip([f.name for f in fields], [*columns, *new], strict=True))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        marks: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for blob in right["blob"].to_pylist():
            doc, rid, owner, first, count = unpacked(blob)
            for at in groups_of(owner):
                i = owner[at[0]]
                marks.setdefault((int(doc[i]), int(rid[i])), []).append((first[at].astype(np.int64), count[at].astype(np.int64)))
        plain = zstandard.ZstdDecompressor()
        texts = ((plain.decompress(z.as_py()) if z.is_valid else None, marks.get(key)) for key, z in zip(_keys(left), left["text"], strict=True))
        out = pa.table(made([left[f.name] for f in carried], texts))
        trim()
        return out

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2000, SLICE):
            batch = batch.filter(pa.array(~touched.value.has(batch.column("__rid").to_numpy(zero_copy_only=False))))
            texts = ((t, None) for t in batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_pydict(made([batch.column(f.name) for f in carried], texts))

    schema = T.StructType(fields)
    cut = _compressed(rows, parts, touched).groupBy("__part").cogroup(found.groupBy("part")).applyInArrow(finish, schema)
    return cut.unionByName(rows.mapInArrow(untouched, schema))

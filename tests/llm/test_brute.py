"""Whole tables against plain implementations of the same contracts."""

import hashlib
import inspect
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.llm import bpe, crf, images, packing, perplexity, queries, ranking, sharding, simhash, suffixes
from veilspark.llm.tokens import library
from veilspark.plans import storage

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def rows(spark, name, sf=SF):
    return queries.QUERIES[name](spark, sf).collect()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def accuracy(spark, name, sf="/root/testdata/sf0.01"):
    return [r for r in rows(spark, name, sf) if r.held_out]


def test_op1_held_out(spark):
    lang = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    out = accuracy(spark, "op1_language_crf")
    assert {r.doc_id for r in out} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97


def test_op1_marks_switched_words():
    words = {"en": ["thing", "that", "when", "there"], "de": ["nicht", "schon", "durch", "zwischen"]}
    rng = random.Random(1)
    docs = [(" ".join(rng.choices(words[g], k=60)), g) for g in ("en", "de") for _ in range(30)]
    tagger = crf.fit([d[0] for d in docs], [d[1] for d in docs], bits=12, rounds=30, sequences=200)
    (post,) = tagger.posteriors([crf.lower("thing that there when nicht durch schon zwischen")])
    assert [tagger.labels[k] for k in post.argmax(axis=1)] == ["en"] * 4 + ["de"] * 4
    assert np.allclose(post.sum(axis=1), 1, atol=1e-4)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 1, 4, 0, 2])
    chain = crf.Chain.of(sizes)
    emission, start, step = rng.random((10, 2)) + 0.1, np.array([0.3, 0.7]), rng.random((2, 2)) + 0.1
    by_time = np.empty_like(emission)
    by_time[chain.place] = emission
    post, moves = crf.forward_backward(by_time, chain, start, step)
    want, want_moves, at = np.zeros_like(emission), np.zeros((2, 2)), 0
    for n in sizes:
        total, local, m = 0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            y = [code >> i & 1 for i in range(n)]
            p = start[y[0]] * np.prod([emission[at + i, y[i]] for i in range(n)]) * np.prod([step[a, b] for a, b in zip(y, y[1:])])
            total += p
            for i in range(n):
                local[i, y[i]] += p
            for a, b in zip(y, y[1:]):
                m[a, b] += p
        if n:
            want[at : at + n], want_moves = local / total, want_moves + m / total
        at += n
    assert np.allclose(post[chain.place], want) and np.allclose(moves, want_moves)


def test_op2_held_out(spark):
    quality = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    out = [r for r in accuracy(spark, "op2_quality_ranking") if r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in out]) > 0.9


def test_op2_learns_like_a_plain_loop():
    """The loss over pairs, its slope and the quantile threshold, against loops over every pair."""
    rng = np.random.default_rng(3)
    good = np.arange(40) % 3 > 0
    matrix = rng.normal(size=(40, ranking.WIDTH)) * 0.1
    matrix[good, 0] += 1.0
    own = ranking.fit(matrix, good)
    s = own.raw(matrix)
    loss = lambda w: np.mean([np.log1p(np.exp(-((matrix[i] - matrix[j]) / own.spread) @ w)) for i in np.flatnonzero(good) for j in np.flatnonzero(~good)])
    assert loss(own.weights) < 0.1 < loss(0 * own.weights)
    assert np.mean([s[i] > s[j] for i in np.flatnonzero(good) for j in np.flatnonzero(~good)]) > 0.99
    assert own.threshold == np.quantile(s, np.mean(~good))
    score = own.score(matrix)
    assert ((score >= 0.7) == (s >= own.threshold)).all() and (np.argsort(score, kind="stable") == np.argsort(s, kind="stable")).all()


def test_op2_learns_from_all_labels(spark):
    """The model of a table is that of all its labelled rows outside the fold, not of a sample, and its threshold their exact quantile."""
    rng = random.Random(6)
    texts = {d: " ".join(rng.choice(("plain", "words", "here", "#!", "X")[: 3 if good else 5]) for _ in range(rng.randint(2, 12))) for d in range(40_000) for good in [d % 3 > 0 or rng.random() < 0.1]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d in texts], "doc_id long, quality int")
    own = ranking.train(docs, labels)
    learned = [d for d in texts if zlib.crc32(str(d).encode()) % 4 != 2]
    matrix, good = np.stack([ranking.features(texts[d]).astype(np.float32) for d in learned]).astype(float), np.array([d % 3 > 0 for d in learned])
    assert len(learned) > 25_000 and np.allclose(own.center, matrix.mean(axis=0), atol=1e-9) and np.allclose(own.spread, matrix.std(axis=0) + 1e-3, atol=1e-9)
    s = own.raw(matrix)
    assert abs(own.threshold - np.quantile(s, np.mean(~good))) < 1e-9 and abs(own.scale - (np.median(s[good]) - np.median(s[~good])) / 6) < 1e-9
    plain = ranking.fit(matrix, good)
    pairs = rng.choices(np.flatnonzero(good).tolist(), k=50_000), rng.choices(np.flatnonzero(~good).tolist(), k=50_000)
    lost = [np.mean(np.logaddexp(0, r.raw(matrix)[pairs[1]] - r.raw(matrix)[pairs[0]])) for r in (own, plain)]
    assert abs(lost[0] - lost[1]) < 1e-3 and np.mean(s[pairs[0]] > s[pairs[1]]) > 0.8
    assert ranking.train(docs, labels).weights.tolist() == own.weights.tolist()


def test_op2_counts_all_pairs():
    rng = np.random.default_rng(2)
    up, down = rng.normal(1, 2, 700), rng.normal(0, 2, 500)
    every = np.logaddexp(0, down[None, :] - up[:, None])
    assert abs(ranking.loss(ranking.cells(up), ranking.cells(down)) - every.mean()) < 1e-3
    at, _ = ranking.cells(up)
    got = ranking.beaten(np.floor(up * ranking.FINE).astype(int), ranking.cells(down))
    assert np.abs(got - (1 - np.exp(-every)).mean(axis=1)).max() < 5e-3


def test_op3_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    theirs = con.sql(f"select doc_id, slot, shard, n_bytes from ({queries.ORACLE_SQL['op3_sharding_lookup']})").fetchall()
    assert sorted(map(tuple, rows(spark, "op3_sharding_lookup"))) == sorted(theirs)


def test_op3_moves_little():
    names = [f"s{i}" for i in range(20)]
    before, after = sharding.lookup_table(names, 2003), sharding.lookup_table(names[:-1], 2003)
    share = Counter(before)
    assert max(share.values()) - min(share.values()) <= 1
    assert np.mean([b != a for b, a in zip(before, after) if names[b] != "s19"]) < 0.2
    heavy = Counter(sharding.lookup_table(["a", "b"], 1009, [3, 1]))
    assert abs(heavy[0] / 1009 - 0.75) < 0.01
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 10)


def test_op4_planted_copies(spark):
    out = {r.media_id: r.class_id for r in rows(spark, "op4_image_copies", "/root/testdata/sf0.01")}
    edits = [m for m in out if m % 2]
    assert np.mean([out[m] == out[m - 1] for m in edits]) >= 0.9
    assert all(c // 2 == m // 2 for m, c in out.items())  # unlike pictures stay apart


def crowded(images_=90, copies=10, seed=5):
    """Corners (id, spot, d0 to d3) of images of which a third hold one piece in every corner; some are shifted copies by that piece alone."""
    rng = np.random.default_rng(seed)
    corners = {}
    for k in rng.permutation(images_).tolist():
        words = rng.integers(-(2**63), 2**63 - 1, (6, 4))
        if k % 3 == 0:
            words[:, 0] = words[:, 0] >> 32 << 32 | 77
        corners[k] = [((int(x) << 30) | (int(y) << 14), *map(int, w)) for x, y, w in zip(rng.integers(20, 90, 6), rng.integers(20, 90, 6), words, strict=True)]
    hot = rng.permutation([k for k in corners if k % 3 == 0]).tolist()
    for a, b in zip(hot[:copies], hot[copies : 2 * copies], strict=True):
        flip = [1 << 40, *[1 << 5 | -1 << 63] * 3]  # one bit in each of the other seven pieces
        near = [(s + (3 << 30), *[(w ^ f) for w, f in zip(d, flip, strict=True)]) for s, *d in corners[a][:4]]
        corners[b][:4] = near
    return [(k, *c) for k, v in corners.items() for c in v]


def test_op4_compares_all_of_a_bucket(spark):
    """Links against brute force, where one piece is in a third of the images."""
    corners = crowded()
    word = lambda x: x & ((1 << 64) - 1)
    votes = Counter()
    for a, s, *u in corners:
        for b, t, *v in corners:
            if a > b:
                off = [(word(x) ^ word(y)) for x, y in zip(u, v, strict=True)]
                if any((o >> h & 0xFFFFFFFF) == 0 for o in off for h in (0, 32)) and sum(o.bit_count() for o in off) <= 24:
                    votes[a, b, (s >> 30) - (t >> 30), (s >> 14 & 0xFFFF) - (t >> 14 & 0xFFFF)] += 1
    want = {(a, b) for (a, b, *_), n in votes.items() if n >= 4}
    assert len(want) == 10
    df = spark.createDataFrame(corners, "id long, spot long, d0 long, d1 long, d2 long, d3 long")
    for crowd, block, few in ((64, 200_000, 0), (8, 50, 0), (1000, 200_000, 0), (64, 60, 99), (64, 10**6, 8)):
        got = images.linked(df, 12, 4, crowd=crowd, block=block, few=few).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want), (crowd, block, few)


def test_op4_hands_on_what_can_agree():
    """Of hot keys all pairs are compared, and pairs of images without enough corners on either side go no further."""
    rng = np.random.default_rng(7)
    ids = np.repeat(np.arange(60), 6)
    words = rng.integers(0, 1 << 63, (360, 4)).astype(np.uint64)
    words[:, 0] = 77  # an equal piece, and many bits that differ
    words[ids % 10 == 0] = words[:6].repeat(6, axis=0).reshape(6, 6, 4).swapaxes(0, 1).reshape(36, 4)  # six images with the same corners
    words[ids == 11] = words[6]  # six corners that are like one of image 1 and of image 21
    words[6 * 21] = words[6]
    spot = (rng.integers(20, 90, 360) << 30) | (rng.integers(20, 90, 360) << 14)
    near = words.view("<u4")
    order = np.argsort(near[:, 0], kind="stable")
    for dense in (1, 1 << 30):
        pairs = {(x, y) for a, b in images.close(near[:, 0], words, near[order, 0], order, words, 32, dense=dense) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        assert pairs == {(x, y) for x in range(360) for y in range(360) if near[x, 0] == near[y, 0] and np.bitwise_count(words[x] ^ words[y]).sum() <= 32}
    side = (ids, spot, words)
    found = np.concatenate(list(images.meet(side, side, np.zeros((4, 0), np.int64), 32, 5, True)), axis=1)
    met = set(zip(found[0].tolist(), found[2].tolist(), strict=True))
    assert met == {(a, b) for a in range(0, 60, 10) for b in range(0, a, 10)}


def test_op4_compares_equal_pieces_alone():
    """A key that the other side lacks meets nothing, also not the next key's rows; and it doesn't matter how many are compared at a time."""
    rng = np.random.default_rng(9)
    ids = np.repeat(np.arange(80), 8)
    words = rng.integers(0, 1 << 63, (80, 8, 4)).astype(np.uint64)
    words[::4] = words[0]  # twenty images of the same corners
    words = words.reshape(-1, 4)
    keys = np.repeat(np.array([76, 77], np.uint32), 8)
    mine, theirs = words[8 * 4 : 8 * 6].copy(), words[8 * 8 : 8 * 10]
    mine[8:] = mine[:8]
    for dense in (1, 1 << 30):
        for upto in (None, np.full(16, 5)):
            pairs = [p for x, y in images.close(keys, mine, np.full(16, 77, np.uint32), np.arange(16), theirs, 32, upto, dense=dense) for p in zip(x.tolist(), y.tolist(), strict=True)]
            assert sorted(pairs) == [(8 + i, i) for i in range(8 if upto is None else 5)]
    side = (ids, (rng.integers(20, 90, 640) << 30) | (rng.integers(20, 90, 640) << 14), words)
    known = np.stack([np.array([0, 1, 9, 79]), np.zeros(4, int), np.array([0, 0, 3, 1]), np.zeros(4, int)])
    for before in (known[:, :0], known):
        out = [np.concatenate(list(images.meet(side, side, before, 32, 5, True, **how)), axis=1) for how in ({}, {"span": 9}, {"most": 1}, {"cells": 1}, {"span": 200, "most": 300, "cells": 500})]
        for m in out:
            assert {tuple(x) for x in m.T.tolist()} == {tuple(x) for x in out[0].T.tolist()} and m.shape == out[0].shape
        assert {(a, b) for a, _, b, _ in out[0].T.tolist()} == {(a, b) for a in range(0, 80, 4) for b in range(0, a, 4)} | set(zip(before[0].tolist(), before[2].tolist(), strict=True))


def test_op4_many_images_of_few_corners():
    """More images than a small number holds, most of them with one corner, cost no array of all their pairs."""
    rng = np.random.default_rng(13)
    ids = np.concatenate((np.zeros(6, int), np.arange(1, 70_000), np.full(6, 70_000)))
    words = rng.integers(0, 1 << 63, (len(ids), 4)).astype(np.uint64)
    words[-6:] = words[:6]
    side = (ids, rng.integers(20, 90, len(ids)) << 30, words)
    none = np.zeros((4, 0), np.int64)
    tracemalloc.start()
    out = np.concatenate(list(images.meet(side, side, none, 32, 5, True)), axis=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(zip(out[0].tolist(), out[2].tolist(), strict=True)) == {(70_000, 0)} and out.shape[1] == 48
    assert peak < 100e6
    known = np.array([[3], [0], [2], [0]])  # goes on, also where the other side has no corners
    for left, right in ((side, tuple(x[:0] for x in side)), (tuple(x[:0] for x in side), side)):
        assert (np.concatenate(list(images.meet(left, right, known, 32, 5, False)), axis=1) == known).all()


def test_op4_packs_corners():
    """Corners come out of blobs by id and in their order, also where an image's lie in several blobs or apart."""
    rng = np.random.default_rng(12)
    ids = rng.integers(-3, 6, 200).repeat(rng.integers(1, 4, 200))
    rows = rng.integers(-(2**63), 2**63 - 1, (len(ids), 5))
    blobs = [images.packed(ids[a : a + 50], rows[a : a + 50]) for a in range(0, len(ids), 50)]
    by = np.argsort(ids, kind="stable")
    got = images.unpacked(blobs)
    assert all((a == b).all() for a, b in zip(got, (ids[by], rows[by, 0], rows[by, 1:].view(np.uint64)), strict=True))
    assert [len(x) for x in images.unpacked([])] == [0, 0, 0]
    assert max(map(len, blobs)) <= 50 * 40 + 8 + 50 * 16


def test_op4_writes_corners_once(spark):
    """Corners are written once, not again for the images that are compared."""
    rng = np.random.default_rng(10)
    blobs = [images.pgm(images.render(rng.normal(size=3).tolist())) for _ in range(6)]
    media = spark.createDataFrame([(k, bytearray(blobs[k % 6])) for k in (3, 3, *range(12))] + [(None, bytearray(blobs[0]))], "media_id long, image binary")
    before = len(storage._WRITTEN)
    out = images.find_copies(media).collect()
    assert sorted((r.media_id, r.class_id) for r in out if r.media_id is not None) == [(k, k % 6) for k in range(12)]
    assert [(r.class_id, r.n_links) for r in out if r.media_id is None] == [(0, 0)]
    assert sum({"d0", "d1", "d2", "d3"} <= set(spark.read.parquet(path).columns) for path in storage._WRITTEN[before:]) == 1


def test_op4_compares_all_bits(spark):
    """Up to 32 of 256 bits may differ, wherever they are."""
    rng = np.random.default_rng(8)
    words = rng.integers(-(2**63), 2**63 - 1, (4, 4)).tolist()

    def links(*flips):
        rows = [(k, (20 + 9 * n << 30) | (20 + 7 * n << 14), *[w ^ f for w, f in zip(d, flip, strict=True)]) for k, flip in ((1, [0] * 4), (2, flips)) for n, d in enumerate(words)]
        df = spark.createDataFrame(rows, "id long, spot long, d0 long, d1 long, d2 long, d3 long")
        return [images.linked(df, inspect.signature(images.find_copies).parameters["reach"].default, 4, crowd=crowd, few=few).count() for crowd, few in ((64, 0), (1, 0), (64, 8))]

    low = [(1 << n) - 1 for n in range(33)]
    assert links(low[5] << 32, low[13] << 32 | 1, low[9] << 32 | 1, low[3] << 32) == [1, 1, 1]  # 32 bits
    assert links(low[16] << 32, 1 << 32, 1 << 32, low[16] << 32 | 1) == [0, 0, 0]


def warped(image, a, size):
    """The picture under a turn and change of scale (a complex number) about its middle, in a frame of ``size``; mirrored where it ends."""
    h, w = image.shape
    y, x = np.mgrid[0:size, 0:size]
    at = ((x - (size - 1) / 2) + 1j * (y - (size - 1) / 2)) / a + (w - 1) / 2 + 1j * (h - 1) / 2
    u, v = (np.minimum(n - 1.001, n - 1 - np.abs(n - 1 - np.abs(x))) for x, n in ((at.real, w), (at.imag, h)))
    i, j = v.astype(int), u.astype(int)
    image = images.box(image.astype(float), 1) * 0.5 + image * 0.5 if abs(a) < 1 else image.astype(float)
    top = image[i, j] * (1 - (u - j)) + image[i, j + 1] * (u - j)
    low = image[i + 1, j] * (1 - (u - j)) + image[i + 1, j + 1] * (u - j)
    return (top * (1 - (v - i)) + low * (v - i)).round().astype(np.uint8)


def test_op4_recall_by_edit(spark, tmp_path):
    """Nine of ten copies or more are found for each kind of edit, of pictures of two sizes; unlike pictures stay apart."""
    rng = np.random.default_rng(6)

    def crop(image, share):
        n = int(image.shape[0] * share)
        y, x = rng.integers(0, image.shape[0] - n + 1, 2)
        return image[y : y + n, x : x + n]

    turn = lambda d: np.exp(1j * np.deg2rad(d))
    edits = {
        "scale 0.75": lambda p: warped(p, 0.75, int(0.75 * len(p))), "scale 0.9": lambda p: warped(p, 0.9, int(0.9 * len(p))), "scale 1.25": lambda p: warped(p, 1.25, int(1.25 * len(p))),
        "crop 0.8": lambda p: crop(p, 0.8), "crop 0.6": lambda p: crop(p, 0.6), "turn 5": lambda p: warped(p, turn(5), len(p)), "turn 40": lambda p: warped(p, turn(40), len(p)), "turn 145": lambda p: warped(p, turn(145), len(p)),
        "noise": lambda p: np.clip(p + rng.normal(0, 8, p.shape), 0, 255).astype(np.uint8), "brightness": lambda p: np.clip(0.7 * p + 30, 0, 255).astype(np.uint8),
    }
    pictures = [images.render(rng.normal(size=9).tolist(), size) for size in (112, 224) for _ in range(10)]
    rows = [(100 * i, images.pgm(p)) for i, p in enumerate(pictures)]
    rows += [(100 * i + 1 + k, images.pgm(edit(p))) for i, p in enumerate(pictures) for k, edit in enumerate(edits.values())]
    for i in range(4):
        ids, blobs = zip(*rows[i::4], strict=True)
        pq.write_table(pa.table({"media_id": ids, "image": pa.array(blobs, pa.binary())}), tmp_path / f"{i}.parquet")
    out = {r.media_id: r.class_id for r in images.find_copies(spark.read.parquet(str(tmp_path))).collect()}
    assert sum(c // 100 != m // 100 for m, c in out.items()) <= 1
    for k, name in enumerate(edits):
        assert np.mean([out[100 * i + 1 + k] == 100 * i for i in range(len(pictures))]) >= 0.9, name


def test_op4_pgm():
    for value in (9, 10, 32, 35):  # pixels that read as white space or as a remark
        picture = np.full((5, 7), value, np.uint8)
        assert (images.decode(images.pgm(picture)) == picture).all()
    assert (images.decode(b"P5\n# made by hand\n2 1\n255\n\x01\x02") == [[1, 2]]).all()
    assert images.decode(b"P5 2 2 255\n\x01") is None


def test_op4_png():
    import struct

    picture = images.render([3.0])
    for mode in range(5):
        lines, above = b"", np.zeros(picture.shape[1], int)
        for row in picture.astype(int):
            left, corner = np.concatenate(([0], row[:-1])), np.concatenate(([0], above[:-1]))
            p = left + above - corner
            far = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
            paeth = np.choose(far.argmin(axis=0), [left, above, corner])
            guess = [0, left, above, (left + above) // 2, paeth][mode]
            lines += bytes([mode]) + ((row - guess) & 255).astype(np.uint8).tobytes()
            above = row
        chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
        head = struct.pack(">IIBBBBB", picture.shape[1], picture.shape[0], 8, 0, 0, 0, 0)
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
        assert (images.decode(png) == picture).all(), mode


def test_op5_counts(spark, texts):
    got = {r.doc_id: r for r in rows(spark, "op5_quality_perplexity")}
    for d, t in texts.items():
        w = WORDS.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        times = Counter(windows)
        covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 8)}
        seen, twice = set(), 0
        for line in t.split("\n"):
            if WORDS.search(line):
                twice += line in seen
                seen.add(line)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_op5_rare_language(spark):
    """Clean documents of a language with few of them stay, and junk among them still goes."""
    rng = random.Random(4)

    def prose(letters, size, words=200):
        vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(words)]
        return lambda: " ".join(rng.choice(vocabulary) for _ in range(size))

    main, rare = prose("etaoin", 400), prose("bcdfghjklmpqrsuvwxyz", 400, 3000)
    docs = [(i, main(), "en") for i in range(200)] + [(1000 + i, rare(), "xx") for i in range(20)]
    docs.append((2000, " ".join("".join(rng.choice("#~^{}=+@") for _ in range(6)) for _ in range(400)), "xx"))
    kept = {r.doc_id for r in perplexity.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect() if r.kept}
    assert set(range(1000, 1020)) <= kept and 2000 not in kept and len(kept & set(range(200))) >= 198


def test_op5_other_scripts(spark):
    """Random letters among prose of a script that is not Latin, with the same word lengths, are told apart."""
    rng = random.Random(8)
    for script in ("אבגדהוזחטיכלמנסעפצקרשת", "абвгдежзиклмнопрстуфхцчшщыьэюя", "あいうえおかきくけこさしすせそたちつてとなにぬねの"):
        vocabulary = ["".join(rng.choices(script, [1 / (i + 1) for i in range(len(script))], k=rng.randint(2, 7))) for _ in range(300)]
        prose = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(150)]
        junk = [" ".join("".join(rng.choice(script) for _ in w) for w in rng.choice(prose).split()) for _ in range(5)]
        docs = [(i, t, "xx") for i, t in enumerate(prose + junk)]
        kept = {r.doc_id for r in perplexity.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect() if r.kept}
        assert len(kept & set(range(150))) >= 148 and not kept & set(range(150, 155))


def test_op5_thousands_of_letters(spark):
    """In a script with thousands of letters random ones among prose are told apart, whether they are among the commonest or not."""
    rng = random.Random(9)
    for first in (0x4E00, 0x20000):
        script = [chr(first + i) for i in range(3000)]
        common, rest = script[:60], script[60:]
        vocabulary = [rng.choice(common) + "".join(rng.choices(rest[:800], k=rng.randint(1, 3))) for _ in range(400)]
        prose = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(150)]
        junk = [" ".join(w[0] + "".join(rng.choices(rest, k=len(w) - 1)) for w in rng.choice(prose).split()) for _ in range(5)]
        docs = [(i, t, "xx") for i, t in enumerate(prose + junk)]
        kept = {r.doc_id for r in perplexity.judge(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect() if r.kept}
        assert len(kept & set(range(150))) >= 148 and not kept & set(range(150, 155))


def test_op5_spells_every_code_point():
    """Texts are read back from the signs, whatever their letters, and n-grams end at each sign."""
    signs = np.where(perplexity.letters(), perplexity.LETTER, perplexity.OTHER).astype(np.uint8)
    signs[32], signs[48], signs[ord("a")] = perplexity.SPACE, perplexity.DIGIT, perplexity.FIRST
    texts = ["a\u4e00 a", "\U0001f600\U00020000a7", "~\uffff", "a"]
    code, start, end, many = perplexity.codes(texts, signs)
    for text, at, to, n in zip(texts, start.tolist(), end.tolist(), many.tolist(), strict=True):
        data, out = (code[at:to] & 63).tolist(), []
        assert n == len(text) and (code[at] >> 6).tolist() == 0
        while data:
            longer = {perplexity.LETTER: 3, perplexity.OTHER: 4}.get(head := data.pop(0), 0)
            value = 0
            for _ in range(longer):
                value = value << 6 | data.pop(0)
            out.append(chr(value) if longer else {perplexity.SPACE: " ", perplexity.DIGIT: "7"}.get(head, "a"))
        assert "".join(out) == text


def test_op5_bands_and_groups(spark, texts):
    """Bands against plain medians, and the same results however few n-grams are sent at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in perplexity.judge(docs).collect()}
    assert {d: (r.kept, r.entropy) for d, r in out.items()} == {r.doc_id: (r.kept, r.entropy) for r in perplexity.judge(docs, grams=1000).collect()}
    near = {}
    for lang in {r.lang for r in out.values()}:
        e = np.sort([round(r.entropy, 3) for r in out.values() if r.lang == lang and not r.base_failed])
        near[lang] = (np.median(e), 1.4826 * np.median(np.abs(e - np.median(e))), len(e))
    every = np.array([round(r.entropy, 3) - near[r.lang][0] for r in out.values() if not r.base_failed])
    usual = max(0.01, 1.4826 * np.median(np.abs(every - np.median(every))))
    for r in out.values():
        mid, dev, n = near[r.lang]
        dev = max(np.sqrt((n * dev**2 + 30 * usual**2) / (n + 30)), 0.005) * np.sqrt(1 + np.pi / 2 / n)
        off = abs(r.entropy - mid) / dev / np.sqrt(1 + 1500 / len(texts[r.doc_id])) if texts[r.doc_id] else 0
        if abs(off - 4) > 0.02:
            assert r.kept == (not r.base_failed and off <= 4)
    assert abs(out[min(out)].perplexity - np.exp(out[min(out)].entropy)) < 1e-9


def test_op5_model(spark, texts):
    """Probabilities sum to one, and equal a plain recursive Kneser-Ney over the same counts."""
    docs = spark.createDataFrame([(t, "x") for t in texts.values()], "text string, lang string")
    signs = perplexity.alphabets(docs)
    count = {r.code: r.n for r in perplexity.count_ngrams(docs, signs).collect()}
    bits, size = perplexity.BITS, perplexity.SIGNS
    plain = Counter()
    for t in texts.values():
        data = [0] * 3 + signs["x"][perplexity.points([t])].tolist()
        plain.update(sum(data[i + j] << bits * (3 - j) for j in range(4)) for i in range(len(data) - 3))
    assert count == dict(plain)
    model = perplexity.Model(np.array(list(count)), np.array(list(count.values())))
    score = lambda c: np.exp(model.score(np.array(c, np.uint32)).astype(float))
    rng = random.Random(2)
    for context in [c >> bits for c in rng.sample(sorted(count), 40)] + [rng.randrange(1 << 18) for _ in range(40)]:
        assert abs(score([context << bits | i for i in range(size)]).sum() - 1) < 1e-5
    part = lambda c: tuple(c >> bits * (3 - j) & size - 1 for j in range(4))
    levels, grams = {}, {part(c): n for c, n in count.items()}
    for k in range(4, 0, -1):
        levels[k] = grams
        grams = Counter(g[1:] for g in grams)
    cuts, whole, spread = {}, defaultdict(float), defaultdict(float)
    for k, level in levels.items():
        t = [sum(n == i for n in level.values()) for i in range(1, 5)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] else 0.5
        cuts[k] = [0] + [min(max(i - (i + 1) * y * t[i] / t[i - 1], 0.05), i - 0.05) if t[i - 1] and t[i] else 0.5 * i for i in (1, 2, 3)]
        for g, n in level.items():
            whole[k, g[:-1]] += n
            spread[k, g[:-1]] += cuts[k][min(n, 3)]

    def probability(g):
        k = len(g)
        below = probability(g[1:]) if k > 1 else 1 / size
        if not whole.get((k, g[:-1])):
            return below
        n = levels[k].get(g, 0)
        return (max(n - cuts[k][min(n, 3)], 0) + spread[k, g[:-1]] * below) / whole[k, g[:-1]]

    for c in [*rng.sample(sorted(count), 200), *[rng.randrange(1 << 24) for _ in range(200)]]:
        assert abs(score([c])[0] - probability(part(c))) < 1e-5


def strip(texts, length=100):
    seen, out = set(), {}
    for key in sorted(texts):
        data = texts[key].encode()
        cover = np.zeros(len(data) + 1, int)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                cover[i] += 1
                cover[i + length] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out[key] = (len(data), int(gone.sum()), spans, sha(np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return out


def test_op6(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op6_suffix_merge")}
    assert got == strip(texts)


def test_op6_whole_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    whole = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op6_suffix_merge", sf)}
    assert got == strip(whole)


def test_op6_many_ranges(spark, texts, monkeypatch):
    """Ranges that are divided further by a hash, with thousands of parts."""
    monkeypatch.setattr(suffixes, "RANGES", 7)
    monkeypatch.setattr(suffixes, "RUN", 300)
    few = dict(sorted(texts.items())[:40])
    df = spark.createDataFrame(list(few.items()), "doc_id long, text string").repartition(3)
    out = suffixes.strip_repeats(df, part_bytes=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == strip(few)


def test_op6_ranges_keep_equal_strings_together():
    rng = np.random.default_rng(4)
    strings = np.sort(rng.integers(97, 100, (400, 6), dtype=np.uint8).view("S6").ravel()).view(np.uint8).reshape(-1, 6)
    cuts = suffixes.strings_of(strings[::40])
    where = suffixes.spread(strings, cuts, 5000)
    assert len(set(where.tolist())) > 100
    assert all(len(set(where[at].tolist())) == 1 for at in suffixes.groups_of(suffixes.strings_of(strings)))


def test_op6_small_blobs_are_cheap():
    """Parts send each other blobs, so those of a large table are many and small: they are read back whole and made faster than by pickling."""
    import pickle
    import time

    import zstandard

    rng = np.random.default_rng(4)
    numbers = [rng.integers(0, 100, 9).astype(t) for t in (np.int64, np.uint64, np.int32, np.uint8, np.int16, bool)]
    fields = (5, *numbers, rng.integers(0, 9, (4, 6), np.uint8), np.zeros((0, 6), np.uint8), np.zeros(0, np.int64), b"", b"tails")
    for x, y in zip(fields, suffixes.unpacked(suffixes.packed(*fields)), strict=True):
        assert np.array_equal(x, y) and (not isinstance(x, np.ndarray) or (x.dtype, x.shape) == (y.dtype, y.shape))

    def seconds(write, read):
        took = []
        for _ in range(7):
            start = time.perf_counter()
            for _ in range(500):
                read(write(*fields))
            took.append(time.perf_counter() - start)
        return min(took)

    plain = seconds(lambda *x: zstandard.ZstdCompressor(1).compress(pickle.dumps(x, 5)), lambda b: pickle.loads(zstandard.ZstdDecompressor().decompress(b)))
    assert seconds(suffixes.packed, suffixes.unpacked) < 0.8 * plain


def test_op6_tells_meeting_hashes():
    """A string that is flagged as a later copy, but has no equal in the merge, is never passed over."""
    one = (0, np.array([1]), np.array([1]), np.array([0]), np.array([0]), np.array([1]), np.array([True]), np.array([0]), b"abcdef")
    table = pa.table({"range": [0], "blob": pa.array([suffixes.packed(*one)], pa.binary())})
    with pytest.raises(RuntimeError):
        list(suffixes._merged(table, 6))


def test_op6_many_parts_and_hard_texts(spark):
    rng = random.Random(6)
    line = "".join(rng.choice("abcd ") for _ in range(140))
    made = {i: "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) + line[rng.randint(0, 30) : rng.randint(90, 140)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 90))) for i in range(150)}
    made |= {200: "a" * 700, 201: "a" * 350, 202: "ab" * 300, 203: line * 9, 204: "é" * 200, 205: "\0" * 300, 206: "\0" * 101 + "\1", 207: "", 208: "q" * 99}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    out = suffixes.strip_repeats(df, part_bytes=4000, keep_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == strip(made)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=6, max_size=6), unique=True, max_size=12), max_size=7))
def test_op6_loser_tree(groups):
    runs, length = [], 6
    for g in groups:
        g = sorted(x.translate(bytes(b % 3 for b in range(256))) for x in g)
        g = sorted(set(g))
        shared = [next((i for i in range(length) if i >= len(b) or a[i] != b[i]), length) for a, b in zip(g, [b"", *g])]
        tails = b"".join(x[n:] for x, n in zip(g, shared))
        assert suffixes.decoded(shared, tails, length) == g
        runs.append((g, shared))
    out = list(suffixes.merge(runs, length))
    strings = [runs[w][0][at] for w, at, _ in out]
    assert strings == sorted(x for g, _ in runs for x in g)
    assert [same for *_, same in out] == [i > 0 and strings[i] == strings[i - 1] for i in range(len(strings))]


def test_op7(spark, texts):
    lib = library(BYTE)
    for r in rows(spark, "op7_bpe_prefix_dp"):
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False).encode())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \t\n'setaoinlrdABCé019.,<|>", max_size=80)))
def test_op7_and_op9_any_text(text):
    from veilspark.llm.token_counts import Counter9

    lib, own = library(BYTE), bpe.codec(BYTE)
    for t in (text, text + "<|endoftext|>" + text):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(packing.id_encoder(BYTE).encode(t), "<u2").tolist() == ids
        assert Counter9(WORD, (zlib.compress(b""), b"")).count(t) == len(library(WORD).encode(t, add_special_tokens=False).ids)


def test_op8(spark, texts):
    lib, out = library(BYTE), rows(spark, "op8_mixture_packing")
    ids = {d: np.array([*lib.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for found, whole in [*[(pieces[d], len(a)) for d, a in ids.items()], *[(s, None) for s in sequences.values()]]:
        at = 0
        for start, n in sorted(found):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= 2048
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= 1 and sorted(sequences) == list(range(len(sequences)))


def test_op9(spark, texts):
    for r in rows(spark, "op9_token_counts"):
        n = len(library(WORD).encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_op10(spark, texts):
    import xxhash

    marks = {}
    for d, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        marks[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {d: d for d in marks}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    order = sorted(marks)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (marks[a] ^ marks[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op10_simhash_ball")} == {d: (f"{marks[d]:016x}", find(d)) for d in order}


def test_op10_links_lose_nothing(spark):
    rng = random.Random(9)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    marks = set(seeds) | {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(8)}
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    group = {m: m for m in signed}
    for _ in range(len(signed)):
        for a in signed:
            for b in signed:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    assert {m: roots.get(m, m) for m in signed} == group


def edit(rng, words, share):
    """A copy of which about that share of words is changed, each apart from the others."""
    out = list(words)
    for i in rng.sample(range(0, len(out), 6), int(share * len(out))):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_against_all_pairs(spark):
    """Every reported group hangs together by pairs of 0.8 or more; nearly all such pairs are reported."""
    rng = random.Random(12)
    texts, d = {}, 0
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400, 900]))]
        for share in (0, 0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.08):
            texts[d] = edit(rng, words, share)
            d += 1
    texts |= {d: [], d + 1: [], d + 2: ["one"], d + 3: ["one"], d + 4: ["one", "two"]}
    docs = spark.createDataFrame([(i, " ".join(w).upper() if i % 2 else " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    root = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert (root[d], root[d + 1], root[d + 2], root[d + 3], root[d + 4]) == (d, d, d + 2, d + 2, d + 4)
    near, exact = [], {i: i for i in texts}

    def find(i):
        while exact[i] != i:
            i = exact[i]
        return i

    for start in range(0, 600, 10):
        for i in range(start, start + 10):
            for j in range(start, i):
                if jaccard(texts[i], texts[j]) >= 0.8:
                    near.append((i, j))
                    x, y = find(i), find(j)
                    exact[max(x, y)] = min(x, y)
    assert len(near) > 500 and np.mean([root[i] == root[j] for i, j in near]) > 0.97
    assert all(find(i) == find(root[i]) for i in range(600))  # nothing is joined that does not hang together
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept == set(root.values())


def test_a_large_group_of_near_copies(spark):
    """A third of all rows are near copies of one text: they make one group."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edit(rng, words, 0.01))) for i in range(300)] + [(1000 + i, " ".join(f"x{rng.randrange(9000)}" for _ in range(100))) for i in range(600)]
    root = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {root[i] for i in range(300)} == {0} and all(root[1000 + i] == 1000 + i for i in range(600))


def test_wide_fingerprint_follows_the_angle():
    rng = np.random.default_rng(1)
    for similar in (0.6, 0.8, 0.95):
        every = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        same = int(2000 * 2 * similar / (1 + similar))
        a, b = every[:2000], np.concatenate((every[:same], every[2000 : 4000 - same]))
        off = np.unpackbits((simhash.spread_bits(a, 64) ^ simhash.spread_bits(b, 64)).view(np.uint8)).mean()
        assert abs(off - simhash.differing(similar)) < 0.02


def test_pipeline_rows(spark, texts):
    """Each stage's decisions, from the operators' own results on that stage's input."""
    from veilspark.llm import stages as P
    from veilspark.llm.common import materialize, read

    docs = read(spark, SF, "documents")
    kept = {r.doc_id for r in perplexity.judge(docs).collect() if r.kept}
    one = materialize(P.quality_rules(spark, docs, SF))
    assert {r.doc_id for r in one.select("doc_id").collect()} == kept
    two = materialize(P.language_id(spark, one, SF))
    assert {r.doc_id for r in two.select("doc_id").collect()} <= kept
    three = materialize(P.near_dedup(spark, two, SF))
    groups = {r.doc_id: r.component_id for r in simhash.near_copies(two).collect()}
    assert {r.doc_id for r in three.select("doc_id").collect()} == set(groups.values())
    four = materialize(P.suffix_dedup(spark, three, SF))
    want = strip({r.doc_id: r.text for r in three.collect()})
    got = four.collect()
    assert {r.doc_id for r in got} == set(want) and all(r.n_chars == len(r.text) for r in got)
    assert sum(len(r.text.encode()) == want[r.doc_id][0] - want[r.doc_id][1] for r in got) >= 0.95 * len(got)
    packed = P.pack(spark, four, SF).collect()
    assert {r.doc_id for r in packed} == set(want)
    whole = rows(spark, "pipeline")
    assert {(r.doc_id, r.doc_tokens) for r in whole} == {(r.doc_id, r.doc_tokens) for r in packed} and sum(r.length for r in whole) == sum(r.length for r in packed)


def test_near_copies_pair_what_is_alike_alone(spark, monkeypatch):
    """Unlike texts, and those that are joined already, are not paired: candidates stay few, however many texts there are."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edit(rng, words, 0.01))) for i in range(400)] + [(1000 + i, " ".join(f"x{rng.randrange(9000)}" for _ in range(30))) for i in range(20_000)]
    made, own = [], simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda *a, **k: made.append(own(*a, **k)) or made[-1])
    root = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {root[i] for i in range(400)} == {0} and all(root[1000 + i] == 1000 + i for i in range(20_000))
    assert sum(df.count() for df in made) < 6 * 400

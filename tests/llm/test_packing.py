"""Mixture and plan of packing, against a queue that is served token by token."""

import heapq
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veilspark.llm import packing

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def served(m):
    """The packed stream, (queue, token) one after the other."""
    due = lambda q, c: float(m.time(np.array([c]), np.array([q]))[0])
    heap = [(due(q, 0), q, 0) for q, n in enumerate(m.tokens) if n]
    heapq.heapify(heap)
    out = []
    while heap:
        _, q, c = heapq.heappop(heap)
        to = min(int(m.tokens[q]), (c + 1) * int(m.turn[q]))
        out += [(q, j) for j in range(c * int(m.turn[q]), to)]
        if to < m.tokens[q]:
            heapq.heappush(heap, (due(q, c + 1), q, c + 1))
    return out


@pytest.mark.parametrize("case", range(40))
def test_plan_equals_service_token_by_token(case):
    rng = np.random.default_rng(case)
    n = int(rng.integers(1, 9))
    tokens = rng.integers(0, 400, n) * (rng.random(n) < 0.9)
    share = rng.random(n) ** 3 if case % 2 else tokens / max(1, tokens.sum())
    m = packing.Mixture(share, tokens, int(rng.integers(1, 60)), int(rng.integers(1, 12)))
    want = {t: (i // m.window, i % m.window) for i, t in enumerate(served(m))}
    places, sums = [], np.zeros(n, np.int64)
    for q in np.flatnonzero(tokens).tolist():
        cuts = sorted({0, int(tokens[q]), *rng.integers(0, tokens[q] + 1, 3).tolist()})  # as partitions hold them
        windows = {}
        for a, b in zip(cuts, cuts[1:]):
            for first, size, w, offset in zip(*[c.tolist() for c in m.spans(q, a, b)]):
                for j in range(size):
                    windows[first + j] = w
                    places.append((w, offset + j))
        assert windows == {j: want[q, j][0] for j in range(int(tokens[q]))}
    assert sorted(places) == [(i // m.window, i % m.window) for i in range(int(tokens.sum()))]


def test_every_window_holds_the_mixture(spark):
    """Twenty sources over several lanes: in each full window each source has its share, to within a token or a turn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = packing.pack(docs, BYTE, lane_tokens=30_000).collect()
    assert len({r.source for r in out}) == 20
    total, share, per = sum(r.length for r in out), Counter(), defaultdict(Counter)
    for r in out:
        share[r.source] += r.length
        per[r.sequence_id][r.source] += r.length
    last = max(per)
    assert sorted(per) == list(range(last + 1)) and last == (total - 1) // 2048
    for w, had in per.items():
        assert sum(had.values()) == (2048 if w < last else total - 2048 * last)
        if w < last:
            for source, n in share.items():
                assert abs(had[source] - 2048 * n / total) <= (2 if 2048 * n / total >= 32 else 33)
    pieces = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for rows in pieces.values():
        rows.sort()
        assert [s for s, *_ in rows] == np.cumsum([0, *[n for _, n, _ in rows]])[:-1].tolist() and sum(n for _, n, _ in rows) == rows[0][2]
    spots = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(spots, spots[1:]))


def test_wanted_mixture_and_rare_sources(spark):
    """Proportions that differ from the corpus hold while both last; rare sources share queues and take turns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "a").when(F.col("doc_id") % 10 < 9, "b").otherwise(F.concat(F.lit("rare"), "doc_id")))
    out = packing.pack(docs, BYTE, mixture={"a": 3.0, "b": 1.0}, lane_tokens=50_000, queues=8).collect()
    per = defaultdict(Counter)
    for r in out:
        per[r.sequence_id][r.source[:1]] += r.length
    both = [w for w, c in per.items() if c["a"] and c["b"]]
    assert len(both) > 20
    for w in sorted(both)[:-1]:
        assert abs(per[w]["a"] / (per[w]["a"] + per[w]["b"]) - 0.75) < 0.02
    want = dict(duckdb.sql(f"select doc_id, 0 from '{SF}/documents.parquet'").fetchall())
    assert {r.doc_id for r in out} == set(want)
    assert Counter(r.length < 2 for r in out if r.source.startswith("rare"))[True] < 0.1 * len(out)

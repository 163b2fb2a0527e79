"""Operator 7: exact byte-pair encoding by dynamic programming over prefixes.

A merge list gives every byte string one encoding, and the last token of each of its
prefixes is unique.  An automaton whose states are the suffixes that may grow into a token
(Aho and Corasick's) reports the tokens that end at each byte; the one that a pair test
accepts behind the prefix in front of it is stored.  Back-pointers from the end then spell
the ids, without any merging of the text.  Decoding reads the ids alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BoundedCache, only, slices
from .tokens import byte_pretokens, chunks, mapped, parts, specials, unmapped

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixEncoder:
    """Encodes pre-tokens; tokens are numbered so that an earlier merge has a lower number."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = {a + b for a, b in merges}
        names = [t for t in vocab if t not in made and len(t) == 1]
        number = {t: i for i, t in enumerate(names)}
        self.split = [(i, i) for i in range(len(names))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            pair = (number[a], number[b])
            if a + b not in number:
                number[a + b] = len(names)
                names.append(a + b)
                self.split.append(pair)
            self.pairs.setdefault(pair, number[a + b])
        self.ids = [vocab[t] for t in names]
        self.bytes = [unmapped(t) for t in names]
        self.lengths = [len(t) for t in names]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(names):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.by_id = {vocab[t]: unmapped(t) for t in names}
        self.table = ByteTable(self.by_id | {i: name.encode() for name, i in specials(path)[1].items()})
        self.tested: dict[tuple[int, int], bool] = BoundedCache(self._compatible, 400_000)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether the merge order leaves these two tokens side by side.

        Undo merges from the latest on; a pair that meets at the boundary must not have a
        merge that would have come before those that are still to be undone.
        """
        left, right = pair
        bound = len(self.split)
        while True:
            if self.pairs.get((left, right), bound) < bound:
                return False
            if left > right:
                bound, inner = left, self.split[left][1]
                if inner != left:
                    left = inner
                    continue
                bound, inner = right + 1, self.split[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, inner = right + 1, self.split[right][0]
                if inner != right:
                    right = inner
                    continue
                bound, inner = left, self.split[left][1]
                if inner == left:
                    return True
                left = inner

    def encode(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        text = mapped(piece)
        last = [-1] * (len(text) + 1)
        lengths, tested = self.lengths, self.tested
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - lengths[token]
                if not start or ((before := last[start]) >= 0 and tested[before, token]):
                    last[end] = token
        out, at = [], len(text)
        while at:
            if (token := last[at]) < 0:
                raise ValueError(f"no token ends at byte {at} of {piece[:50]!r}")
            out.append(self.ids[token])
            at -= lengths[token]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


class ByteTable:
    """The bytes of every id, end to end."""

    def __init__(self, by_id: dict[int, bytes]):
        top = max(by_id, default=0) + 1
        self.size = np.fromiter((len(by_id.get(i, b"")) for i in range(top)), np.int64, top)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that a run of ids stands for."""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)
        return self.flat[at].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


class Codec:
    """Whole texts to ids and back; keeps the ids of pre-tokens seen lately, up to a limit."""

    def __init__(self, path: str, cached: int = 400_000):
        self.path, self.encoder = path, encoder(path)
        self.cache = BoundedCache(lambda piece: self._both(self.encoder.encode(piece)), cached)

    @staticmethod
    def _both(ids: list[int]) -> tuple[str, bytes]:
        """Ids as decimal text and as bytes."""
        return ",".join(map(str, ids)), np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> Iterator[list[tuple[str, bytes]]]:
        """Runs of pre-tokens as their ids, in both forms."""
        _, added = specials(self.path)
        for i, part in enumerate(parts(text, self.path)):
            if i % 2:
                yield [self._both([added[part]])]
            elif part:
                for chunk in chunks(part):
                    yield list(map(self.cache.__getitem__, byte_pretokens(chunk, self.path)))

    def encode(self, text: str) -> list[int]:
        return [i for run in self.pieces(text) for _, raw in run for i in np.frombuffer(raw, "<u4").tolist()]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes with special tokens kept."""
        return self.encoder.table.decode(np.array(ids, np.int64)).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Tokens, SHA-256 of the ids joined by commas, SHA-256 of what the ids decode to."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for run in self.pieces(text):
            ids_hash.update((b"," if n else b"") + ",".join([r[0] for r in run]).encode())
            ids = np.frombuffer(b"".join([r[1] for r in run]), "<u4")
            n += len(ids)
            text_hash.update(self.encoder.table.decode(ids).decode("utf-8", "replace").encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; no shuffle.

    Null and empty texts have no tokens and the digests of empty strings; very long texts are
    cut where pre-tokens always end, so their ids are the same.  Repeated rows and rows without
    a doc_id give a row each; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "text", 4000, 8 << 20):
            rows = [own.digest(t or "") for t in batch.column("text").to_pylist()]
            n, ids, back = zip(*rows, strict=True)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, "doc_id", "text").mapInArrow(run, ENCODED)

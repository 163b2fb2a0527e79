"""What a worker holds at a time, without Spark."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from veilspark.llm import crf

WORDS = {"de": "der die das und nicht durch schon zwischen".split(), "en": "the of thing that there when which was".split()}


def test_language_id_holds_few_words_at_a_time(monkeypatch):
    """Twelve MB of text in one batch: words and arrays of all of it would be hundreds of MB."""
    rng = random.Random(5)
    learned = [(" ".join(rng.choices(WORDS[k], k=40)), k) for k in ("de", "en") * 20]
    tagger = crf.fit([t for t, _ in learned], [k for _, k in learned], bits=10, rounds=5, sequences=100)
    texts = [" ".join(rng.choices(WORDS[k], k=1500)) for k in ("de", "en") * 700] + [None, "", "123 ."]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string())})
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    docs = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), schema=None, mapInArrow=lambda run, schema: run)
    monkeypatch.setattr(crf, "train", lambda docs: tagger)
    tracemalloc.start()
    try:
        kept = [i for out in crf.keep_languages(docs)(iter([batch])) for i in out.column("doc_id").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert kept == list(range(1400))
    assert peak < 60e6, peak


def test_words_read_in_parts_are_the_same_words():
    rng = random.Random(6)
    texts = [" ".join(rng.choices(WORDS["de"] + WORDS["en"], k=rng.randrange(60))) for _ in range(50)] + [None, "", "² 1"]
    tagger = crf.fit(texts[:50], ["de", "en"] * 25, bits=10, rounds=3, sequences=50)
    whole, parts = tagger.read(texts, 1 << 30), tagger.read(texts, 1)
    for a, b in zip(whole, parts, strict=True):
        assert np.array_equal(a, b)
    assert whole[0].tolist() == [len(crf.lower(t or "")) for t in texts]
    assert whole[1].tolist() == [not any(c.isalpha() for c in t or "") for t in texts]

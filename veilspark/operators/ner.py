"""Model-based recognizers as plug-ins: functions from texts to spans, loaded once a worker and called by batches."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import CLIENT
from .detect import FOUND_TYPE, as_found

#: Answers each text with its spans, or with the exception that it ended in.
Recognizer = Callable[[list[str]], list[list[dict] | Exception]]
_LOADED: dict[object, Recognizer] = {}
PEOPLE = {"PER", "PERS", "PERSON"}
FIELDS = ("start", "end", "entity_type", "text")
#: Texts, and their characters, up to which a recognizer is asked at once.
ASKED, CHARS = 256, 1 << 20


def loaded(key: object, load: Callable[[], Recognizer]) -> Recognizer:
    """The worker's one copy of a recognizer."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def unload(key: object) -> bool:
    return _LOADED.pop(key, None) is not None


def one_by_one(fn: Callable[[str], list[dict]]) -> Recognizer:
    """A recognizer from a function of a single text."""

    def run(texts: list[str]) -> list[list[dict] | Exception]:
        out: list[list[dict] | Exception] = []
        for text in texts:
            try:
                out.append(fn(text))
            except Exception as e:  # that text alone
                out.append(e)
        return out

    return run


def recognizer(load: Callable[[], Recognizer], key: str) -> Callable[[Column], Column]:
    """A column function over texts, ``struct<spans, error>``.

    Each distinct text of a batch is asked about once, ``ASKED`` texts at a time.  A text on
    which the recognizer fails, and every text where it can't be loaded, has no spans and tells
    the error: the rest of masking goes on, and the caller hears of it.
    """

    def answered(texts: list[str]) -> list[tuple[list[tuple], str | None]]:
        try:
            answers = loaded(key, load)(texts)
            pairs = list(zip(texts, answers, strict=True))
        except Exception as e:  # a model or service that is down never stops the rest
            pairs = [(t, e) for t in texts]
        return [([], repr(a)) if isinstance(a, Exception) else ([tuple(s[k] for k in FIELDS) for s in a], None) for _, a in pairs]

    @F.arrow_udf(FOUND_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        coded, answers, some, size = texts.dictionary_encode(), [], [], 0
        for text in coded.dictionary:
            some.append(text.as_py())
            size += len(some[-1])
            if len(some) >= ASKED or size >= CHARS:
                answers += answered(some)
                some, size = [], 0
        if some:
            answers += answered(some)
        return as_found(([], None) if i is None else answers[i] for i in coded.indices.to_pylist())

    return run.asNondeterministic()


def service(url: str, timeout: float = 5.0, enabled: bool = True, at_once: int = 8) -> Callable[[], Recognizer]:
    """A recognizer behind HTTP: ``POST url/recognize {"text": ...}`` answers ``{"spans": [...]}``; ``at_once`` requests run side by side."""

    def ask(text: str) -> list[dict] | Exception:
        body = json.dumps({"text": text}).encode()
        try:
            request = urllib.request.Request(url.rstrip("/") + "/recognize", body, {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.load(answer).get("spans", [])
        except Exception as e:
            return e

    def load() -> Recognizer:
        def run(texts: list[str]) -> list[list[dict] | Exception]:
            if not enabled:
                return [[] for _ in texts]
            with ThreadPoolExecutor(at_once) as pool:
                return list(pool.map(ask, texts))

        return run

    return load


def transformers_model(name: str, batch: int = 16) -> Callable[[], Recognizer]:
    """A token-classification model; people become clients.  Needs the transformers library."""

    def load() -> Recognizer:
        from transformers import pipeline

        model = pipeline("token-classification", model=name, aggregation_strategy="simple")
        of = lambda text, found: [{"start": int(e["start"]), "end": int(e["end"]), "entity_type": CLIENT, "text": text[e["start"] : e["end"]]} for e in found if e["entity_group"].upper() in PEOPLE]
        return lambda texts: [of(t, f) for t, f in zip(texts, model(texts, batch_size=batch), strict=True)]

    return load

"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from veilspark.llm import bpe, crf, images, packing, perplexity, ranking, sharding, simhash, stages, suffixes, token_counts
from veilspark.llm.common import materialize

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LONG = "".join(chr(97 + (i * i) % 26) + (" " if i % 7 == 0 else "") for i in range(400_000))
PLAIN = "The thing is that one of them was there and then it went to the end of the line. " * 4
ROWS = [
    (None, None, None, None), (None, PLAIN, "en", None), (1, "", "en", "a"), (2, " \t\n", "en", "a"), (3, PLAIN, "en", "a"), (3, PLAIN, "en", "a"),
    (4, LONG, "en", "b"), (5, None, "de", None), (6, "!!! 123 ...", None, "b"), (7, "Der die das und ist nicht ein Wort. " * 9, "de", "b"),
    (8, "日本語 😀 ' <|endoftext|> É", "de", "b"), (9, "x", "en", "a"),
]
EXTRA = ["rid", "__rid", "fp", "lane", "bucket", "part", "__part", "score", "kept", "n_bytes", "slot", "shard", "entropy", "n"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for i, name in enumerate(EXTRA):
        df = df.withColumn(name, F.lit(f"mine{i}"))
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


EVERY = sorted((r[0] for r in ROWS), key=lambda x: (x is None, x))


def test_language(docs, empty):
    out = crf.identify(docs).collect()
    assert sorted((r.doc_id for r in out), key=lambda x: (x is None, x)) == EVERY
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 5, 6))
    assert by[8].lang_pred != "und" and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out for r in out if r.doc_id is None)
    assert crf.identify(empty).count() == 0
    assert crf.keep_languages(docs).columns == docs.columns and 6 not in ids(crf.keep_languages(docs))


def test_ranking(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (7, 1, 0), (6, 0, 0), (9, 0, 1), (None, 1, 0), (4, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = ranking.rank(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert ranking.rank(empty, labels).count() == 0
    assert ranking.rank(docs, labels.where("doc_id < 0")).count() == len(ROWS)


def test_sharding(docs, empty):
    out = sharding.place(docs, F.col("doc_id"), ["a", "b", "c"], 31)
    assert set(docs.columns) <= set(out.columns) and ids(out) == EVERY
    assert len({r.shard for r in out.where("doc_id = 3").collect()}) == 1 and sharding.place(empty, F.col("doc_id"), ["a"], 7).count() == 0


def test_images(spark):
    picture = images.pgm(images.render([1.0, 2.0]))
    rows = [(1, picture), (2, picture), (2, picture), (None, picture), (3, None), (4, b""), (5, b"junk"), (6, b"P5 0 0 255\n"), (None, None), (7, images.pgm(images.edited(images.render([1.0, 2.0]), 0, 1)))]
    media = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "media_id long, image binary").withColumn("spot", F.lit("mine"))
    found = images.find_copies(media).collect()
    out = {r.media_id: r.class_id for r in found}
    assert {r.media_id: r.decoded for r in found if r.media_id} == {k: k in (1, 2, 7) for k in range(1, 8)}
    assert len({r.n_corners for r in found if r.media_id in (1, 2)}) == 1
    assert out[1] == out[2] == out[7] == 1 and out[3] == out[4] == 3 and out[5] == 5 and out[6] == 6
    assert images.find_copies(media.where("media_id > 100")).count() == 0


def test_rules(docs, empty):
    out = perplexity.judge(docs).collect()
    assert sorted((r.doc_id for r in out), key=lambda x: (x is None, x)) == EVERY
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].n_words == by[5].n_words == by[2].n_words == 0 and by[1].entropy is None and by[5].base_failed and not by[5].kept
    assert perplexity.judge(empty).count() == 0 and perplexity.keep_passing(empty).count() == 0


def test_suffixes(docs, empty):
    out = suffixes.strip_repeats(docs, keep_text=True)
    rows = out.collect()
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == EVERY
    copies = sorted(r.n_removed for r in rows if r.doc_id == 3)
    assert copies[1] == len(PLAIN)  # the second of equal rows goes, and the copy without an id
    assert [r.n_removed for r in rows if r.doc_id is None and r.n_bytes] == [len(PLAIN)]
    assert all(r.kept is None and r.n_bytes == 0 for r in rows if r.doc_id == 5)
    assert suffixes.strip_repeats(empty).count() == 0


def test_bpe_and_counts(docs, empty):
    out = bpe.encode_digests(docs, BYTE)
    nothing = hashlib.sha256(b"").hexdigest()
    assert ids(out) == EVERY and all(r.ids_sha256 == r.decoded_sha256 == nothing for r in out.where("doc_id in (1, 5)").collect())
    assert all(r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for r in out.collect() for i, t, *_ in ROWS if i is not None and i == r.doc_id and t)
    counts = token_counts.count_tokens(docs, WORD)
    assert ids(counts) == EVERY and {r.doc_id: r.n_tokens for r in counts.collect()}[5] == 0
    assert bpe.encode_digests(empty, BYTE).count() == 0 and token_counts.count_tokens(empty, WORD).count() == 0


def test_packing(docs, empty):
    out = packing.pack(docs, BYTE).collect()
    assert sorted({r.doc_id for r in out}, key=lambda x: (x is None, x or 0)) == sorted(set(EVERY), key=lambda x: (x is None, x or 0))
    assert [(r.length, r.doc_tokens, r.ids_crc32) for r in out if r.doc_id == 5] == [(1, 1, zlib.crc32(b"\1\0\0\0"))]
    assert packing.pack(empty, BYTE).count() == 0
    assert sum(r.length for r in packing.pack(docs, BYTE, mixture={"a": 3.0, "zzz": 1.0}).collect()) == sum(r.length for r in out)


def test_simhash(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id for r in out), key=lambda x: (x is None, x)) == EVERY
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {None, 1, 2, 5} and {r.component_id for r in zero} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and ids(kept).count(3) == 1 and None not in ids(kept)


def test_pipeline(spark, docs, empty):
    for frame in (docs, empty):
        out = frame
        for name, stage in stages.STAGES[:-1]:
            out = materialize(stage(spark, out, ""))
            assert out.columns == docs.columns, name
        packed = stages.pack(spark, out, "").collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in out.collect()}


def test_frames_that_are_no_files(spark, docs):
    """Rows keep their numbers when a frame is computed anew, and when one file row has become several."""
    from veilspark.plans.storage import is_scan

    made = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    twice = docs.select("doc_id", "text", "lang", "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    assert is_scan(docs.where("doc_id > 1").select("doc_id")) and not is_scan(made) and not is_scan(twice) and not is_scan(docs.union(docs))
    assert ids(simhash.keep_one(made)) == ids(simhash.keep_one(twice)) == ids(simhash.keep_one(docs))
    assert ids(perplexity.keep_passing(made)) == ids(perplexity.keep_passing(docs))
    assert sorted(r.n_removed for r in suffixes.strip_repeats(twice).where("doc_id = 3").collect())[1:] == [len(PLAIN)] * 3

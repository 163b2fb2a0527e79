import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.functions import fixed as L
from veilspark.operators import detect, guard, mask, ner, restore, vault
from veilspark.plans.queries import ORACLE_SQL, QUERIES
from veilspark.plans.storage import numbered
from veilspark.sources import vaults
from veilspark.streaming import deltas as S

DOCS = [
    (1, "host 1.43.173.185 of a@b.org", "en", "s1", 28),  # the dots part a valid id
    (2, "token 9742a250774262d69 and 4111111111111111", "fr", "s2", 44),
    (3, "call 0411590525 now", "fr", "s3", 19),
    (4, "nothing", "de", "s3", 7),
]


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    mine, theirs = QUERIES[name](spark, str(folder)), con.sql(ORACLE_SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda names, found: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall())


@pytest.fixture
def documents(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return tmp_path


@pytest.mark.parametrize("name", ["entity_counts_by_lang", "entity_counts_by_source", "mode_shadow", "mask_repeated_rows", "mask_null_keys", "mask_each_content_once", "mask_documents"])
def test_documents_with_ids_and_phones(spark, documents, name):
    same_as_sql(spark, name, documents)


def test_only_some_types():
    text = " ".join(d[1] for d in DOCS)
    assert {s[2] for s in detect.spans_of(text)} == {L.EMAIL, L.CARD, L.PHONE, L.NEUTRAL_ID}
    assert [s[2:] for s in detect.spans_of(text, frozenset([L.CARD]))] == [(L.CARD, "4111111111111111")]


def test_leak_count_hands_on_few_strings(spark):
    """Strings that are no values stay where they are: one bit a value let through a tenth of all places."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(8, 40)))
    reals = [word() for _ in range(12_000)]
    texts = spark.createDataFrame([("s", " ".join(word() for _ in range(200))) for _ in range(50)] + [("s", " ".join(reals[:5]))], "vault_key string, text string")
    book = spark.createDataFrame([("s", r) for r in reals], "vault_key string, real string")
    found = vault.candidates(texts, book.select("vault_key", F.encode("real", "UTF-8").alias("value")))
    assert 5 <= found.count() < 50
    assert vault.present(texts, book).first().n_present == 5


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_texts_go_to_python_once(spark, documents):
    """A filter on what a Python function finds does not run it again, and two functions share a worker."""
    rows = numbered(spark.read.parquet(f"{documents}/documents.parquet").selectExpr("source AS vault_key", "doc_id AS seq", "text"))
    model = ner.recognizer(lambda: ner.one_by_one(lambda t: [{"start": 0, "end": 1, "entity_type": "x", "text": t[:1]}]), "first letter")
    assert python_steps(mask.findings(rows)) == 1
    assert python_steps(mask.findings(rows, secondary=model)) == 1
    tried = rows.withColumn("tried", restore.attempted(lambda t, m: t)(F.col("text"), F.create_map().cast("map<string,string>")))
    assert python_steps(tried.where("tried.error is null").select("tried.text")) == 1


def test_recognizer_asks_by_parts(spark):
    """Each distinct text is asked about once, and few at a time."""

    def load():
        seen = []

        def run(texts):
            seen.append(len(texts))
            return [[{"start": 0, "end": seen[-1], "entity_type": str(sum(seen)), "text": t}] for t in texts]

        return run

    texts = [f"t{i % 600}" for i in range(1200)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    found = df.select("text", ner.recognizer(load, "parts")(F.col("text")).alias("f")).collect()
    assert all((r.f.spans == []) if r.text is None else (r.f.spans[0].text == r.text and r.f.spans[0].end <= ner.ASKED) for r in found)
    assert max(int(r.f.spans[0].entity_type) for r in found if r.text) == 600


@pytest.mark.parametrize("flush", [False, True])
def test_held_deltas_equal_a_loop(spark, flush):
    """Turns that end within a mark, null keys and null texts, over batches of a few rows."""
    rng = random.Random(7)
    rows = [(s, t, i, rng.choice(["a", "\u27e6", "x_1", "\u27e7", None, "b\u27e6c", "z" * 30])) for s in ("s", None) for t in (1, 2, None) for i in range(rng.randint(20, 40))]
    want, held, key = [], "", None
    for s, t, i, text in rows:
        if (s, t) != key:
            if flush and held:
                want[-1] = (*want[-1][:3], want[-1][3] + held)
            held, key = "", (s, t)
        sent, held = S.advance(held, text)
        want.append((s, t, i, sent))
    if flush and held:
        want[-1] = (*want[-1][:3], want[-1][3] + held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = S.hold_back(spark.createDataFrame(rows, "session_id string, turn long, delta_idx int, text string"), flush=flush).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_deltas_are_held_back_once(spark):
    deltas = spark.createDataFrame([("s", 1, 0, "\u27e6a_1\u27e7")], "session_id string, turn long, delta_idx int, text string")
    book = spark.createDataFrame([("s", "\u27e6a_1\u27e7", "real")], "vault_key string, token string, real string")
    back = S.restored_deltas(S.hold_back(deltas), book)
    assert "MapInArrow" not in back._jdf.queryExecution().executedPlan().toString() and back.first().text == "real"


def test_no_proof_where_none_is_asked_for(spark, monkeypatch):
    messages = spark.createDataFrame([("s", 0, "a@b.org")], "vault_key string, seq long, text string")
    monkeypatch.setattr(vault, "present", lambda *a: pytest.fail("the leak count was made"))
    assert messages.transform(guard.outbound_hook(lambda: "enforce")).first().sent == "\u27e6מייל_1\u27e7"


def test_vault_files_come_from_several_tasks(spark, tmp_path):
    book = spark.createDataFrame([(f"s{i}", "r", "\u27e6a_1\u27e7", "a", 1) for i in range(40)], "vault_key string, real string, token string, entity_type string, n int")
    for _ in range(2):  # the second time over the first
        vaults.write_files(book, str(tmp_path / "v"))
        files = [p.name for p in (tmp_path / "v").rglob("part-*")]
        assert len(files) == 40 and len({name[:10] for name in files}) > 3
    assert vaults.read_files(spark, f"{tmp_path}/v/*").count() == 40 and [p.name for p in tmp_path.iterdir()] == ["v"]

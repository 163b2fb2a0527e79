import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions import checks
from veilspark.functions import fixed as L
from veilspark.operators import detect
from veilspark.plans.qa import valid_ids

ID = valid_ids(1)[0]
PARTED = f"{ID[:2]}-{ID[2:8]}-{ID[8]}"

CASES = [
    (f'ת"ז {ID} כאן', {(L.PERSON_ID, ID)}),
    (f"ח.פ {PARTED} של", {(L.COMPANY_ID, PARTED)}),
    (f"סתם {ID} כאן", {(L.NEUTRAL_ID, ID)}),
    (f"סתם {PARTED} כאן", {(L.NEUTRAL_ID, PARTED)}),
    (f"סתם {int(ID) + 1:09d} כאן", set()),
    ("נייד 052-7654321", {(L.PHONE, "052-7654321")}),
    ("נייד +972-52-7654321.", {(L.PHONE, "+972-52-7654321")}),
    ("02 7000009", set()),  # a phone with a gap whose digits make an id is nobody's
    ("a.b+c@d-e.co.il, x", {(L.EMAIL, "a.b+c@d-e.co.il")}),
    ("4111 1111 1111 1111", {(L.CARD, "4111 1111 1111 1111")}),
    ("4111 1111 1111 1111 2024", set()),  # swallowed whole, fails its check
    ("5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5", set()),
    ('פש"ר 54321 וגוש 12 חלקה 3', {(L.CASE, "54321"), (L.PARCEL, "גוש 12 חלקה 3")}),
    ("😀 052-7654321 ✓", {(L.PHONE, "052-7654321")}),
    ("", set()),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_single_texts(text, expected):
    assert {(s[2], s[3]) for s in detect.spans_of(text)} == expected
    assert all(text[s[0] : s[1]] == s[3] for s in detect.spans_of(text))


def test_native_equals_batched(spark):
    rng = random.Random(5)
    words = [c[0] for c in CASES] + ["ח.ל.צ", "תיק: 4321", ID, PARTED, "x@y.zz", "12-34", "😀", " ", "٣٤٥"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", detect.native(F.col("text")).alias("a"), detect.detect(F.col("text")).alias("b")).collect()
    assert sum(len(r.b) for r in rows) > 200
    for r in rows:
        assert r.a == r.b, r.text


def test_check_digits(spark):
    numbers = [f"{n:09d}" for n in range(123456700, 123456800)] + ["12345678", "", "4111111111111111", "4111111111111112", "1" * 20]
    df = spark.createDataFrame([(n,) for n in numbers], "d string")
    for r in df.select("d", checks.valid_id(F.col("d")).alias("i"), checks.luhn(F.col("d")).alias("c")).collect():
        assert r.i == checks.is_valid_id(r.d) and r.c == checks.is_luhn(r.d)


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("٠١٢-3",)], "t string")
    assert df.select(checks.digits(F.col("t"))).first()[0] == "0123"

import base64
import json
import os
import time

from pyspark.sql import functions as F

from veilspark.operators import egress
from veilspark.streaming import deltas as S

MAP = {"⟦א_1⟧": "real", "⟦א_2⟧": 'quo"te'}


def requests(spark, **kw):
    row = {"url": "https://u@h.example:88/p?q=1", "json": None, "data": None, "form": None, "tokens": MAP} | kw
    df = spark.createDataFrame([tuple(row.values())], "url string, json string, data string, form map<string,string>, tokens map<string,string>")
    return egress.restore_requests(df).first()


def test_bodies(spark):
    r = requests(spark, json='{"a":{"⟦א_1⟧":"⟦א_1⟧ ⟦z_1⟧"}}')
    assert json.loads(r.json) == {"a": {"real": "real ⟦z_1⟧"}} and r.changed
    r = requests(spark, json='{"a":"⟦א_2⟧"}', data="⟦א_1⟧")
    assert r.json == '{"a":"⟦א_2⟧"}' and r.data == "⟦א_1⟧" and not r.changed  # it would no longer be JSON
    assert requests(spark, data="x=⟦א_1⟧").data == "x=real"
    long = "MIME ⟦א_1⟧ " * 20
    r = requests(spark, data=base64.b64encode(long.encode()).decode())
    assert base64.b64decode(r.data).decode() == long.replace("⟦א_1⟧", "real") and r.changed
    for body in ("plain", base64.b64encode(b"\xff\xfe\x00").decode(), "abc=", ""):
        r = requests(spark, data=body)
        assert r.data == body and not r.changed
    r = requests(spark, form={"a": "⟦א_1⟧", "b": None})
    assert r.form == {"a": "real", "b": None} and r.changed


def test_switch_audit_and_bytes(spark):
    df = spark.createDataFrame([("https://u@h.example:88/p", True), ("nonsense", True), ("http://x/", False)], "url string, changed boolean")
    assert sorted(r.host for r in egress.restored_audit(df).collect()) == ["", "u@h.example:88"]
    one = spark.createDataFrame([("⟦א_1⟧ ⟦z_1⟧ ⟦z_1⟧", bytearray("⟦א_1⟧".encode()), MAP)], "t string, b binary, tokens map<string,string>")
    r = one.select(egress.restore_content(F.col("t"), F.col("tokens")).alias("c"), egress.restore_bytes(F.col("b"), F.col("tokens")).alias("b")).first()
    assert r.c.text == "real ⟦z_1⟧ ⟦z_1⟧" and r.c.leftover == ["⟦z_1⟧", "⟦z_1⟧"] and bytes(r.b.body) == b"real"
    lines = egress.leftover_audit(one.select(F.array(F.lit("⟦z_1⟧")).alias("leftover")), F.lit("send")).first()
    assert lines.kind == "egress_leftover" and lines.tokens == ["⟦z_1⟧"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("to ⟦א_1⟧\n⟦z_1⟧", encoding="utf-8")
    (tmp_path / "in" / "b.txt").write_text("nothing", encoding="utf-8")
    (tmp_path / "in" / "c.bin").write_bytes(b"\xff\xfe \xe2\x9f")
    before = os.stat(tmp_path / "in" / "b.txt").st_mtime_ns
    known = spark.createDataFrame(list(MAP.items()), "token string, real string")
    out = egress.restore_files(spark, str(tmp_path / "in"), known, str(tmp_path / "out"))
    rows = {r.path.rsplit("/", 1)[1]: r for r in out.collect()}
    assert rows["a.txt"].changed and rows["a.txt"].leftover == ["⟦z_1⟧"] and not rows["b.txt"].changed and "c.bin" not in rows
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.txt", "b.txt"]
    assert (tmp_path / "out" / "a.txt").read_text(encoding="utf-8") == "to real\n⟦z_1⟧"
    egress.restore_files(spark, str(tmp_path / "in"), known, audit=str(tmp_path / "log"))
    assert (tmp_path / "in" / "a.txt").read_text(encoding="utf-8") == "to real\n⟦z_1⟧"
    assert os.stat(tmp_path / "in" / "b.txt").st_mtime_ns == before  # only what changes is written
    line = spark.read.json(str(tmp_path / "log")).first()
    assert (line.kind, line["where"], line.tokens) == ("egress_leftover", "file:a.txt", ["⟦z_1⟧"])


PARTS = ["answer: ", "⟦לק", "וח_1⟧", " end ⟦", "x" * 60, " tail ⟦a"]


def test_hold_back():
    held, out = "", []
    for p in PARTS:
        sent, held = S.advance(held, p)
        out.append(sent)
    assert out == ["answer: ", "", "⟦לקוח_1⟧", " end ", "⟦" + "x" * 60, " tail "] and held == "⟦a"
    assert S.advance("", "⟦" + "y" * 47) == ("", "⟦" + "y" * 47) and S.advance("", "⟦" + "y" * 48)[1] == ""


def test_batch_form(spark):
    rows = [(s, 1, i, p) for s in ("a", "b", "c") for i, p in enumerate(PARTS)]
    df = spark.createDataFrame(rows, "session_id string, turn long, delta_idx int, text string")
    whole = "".join(PARTS)
    assert {r.text for r in S.joined_replies(S.hold_back(df)).collect()} == {whole[:-2]}
    assert {r.text for r in S.joined_replies(S.hold_back(df, flush=True)).collect()} == {whole}
    assert S.hold_back(df.limit(0)).count() == 0


def test_streaming_form(spark, tmp_path):
    schema = "session_id string, turn long, delta_idx int, text string"
    source = tmp_path / "deltas"
    source.mkdir()
    stream = S.hold_back_stream(spark.readStream.schema(schema).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    got = []
    try:
        for i, p in enumerate(PARTS):
            spark.createDataFrame([("a", 1, i, p)], schema).write.mode("append").parquet(str(source))
            end = time.time() + 30  # with a timeout set, the query never calls itself done
            while len(got) <= i and time.time() < end:
                time.sleep(0.2)
                got = [r.text for r in spark.table("held").orderBy("delta_idx").collect()]
    finally:
        query.stop()
    assert got == ["answer: ", "", "⟦לקוח_1⟧", " end ", "⟦" + "x" * 60, " tail "]


def test_streamed_restore(spark, tmp_path):
    """From deltas to restored text, with the vault and the mode read for each batch."""
    schema = "session_id string, turn long, delta_idx int, text string"
    source = tmp_path / "deltas"
    source.mkdir()
    book = [("s", "⟦לקוח_1⟧", "Ada")]
    got: dict[int, list] = {}
    query = S.restore_stream(
        spark.readStream.schema(schema).parquet(str(source)),
        lambda: spark.createDataFrame(book, "vault_key string, token string, real string"),
        lambda batch, number: got.__setitem__(number, [(r.delta_idx, r.text) for r in batch.collect()]),
        str(tmp_path / "cp"),
    )
    try:
        for i, p in enumerate(["hello ⟦לק", "וח_1⟧ and ⟦ל", "קוח_2⟧"]):
            spark.createDataFrame([("s", 1, i, p)], schema).write.mode("append").parquet(str(source))
            end = time.time() + 60
            while sum(map(len, got.values())) <= i and time.time() < end:
                time.sleep(0.2)
            if i == 1:
                book.append(("s", "⟦לקוח_2⟧", "Bob"))
    finally:
        query.stop()
    sent = sorted(row for rows in got.values() for row in rows)
    assert sent == [(0, "hello "), (1, "Ada and "), (2, "Bob")]


def test_held_text_is_flushed(spark, tmp_path):
    schema = "session_id string, turn long, delta_idx int, text string"
    source = tmp_path / "deltas"
    source.mkdir()
    stream = S.hold_back_stream(spark.readStream.schema(schema).parquet(str(source)), ttl_ms=1, flush=True)
    query = stream.writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    got = []
    try:
        spark.createDataFrame([("a", 1, 0, "x ⟦open")], schema).write.mode("append").parquet(str(source))
        end = time.time() + 60
        while len(got) < 2 and time.time() < end:
            time.sleep(0.2)
            got = [(r.delta_idx, r.text) for r in spark.table("flushed").orderBy("delta_idx").collect()]
    finally:
        query.stop()
    assert got == [(0, "x "), (1, "⟦open")]


def test_job_and_send(spark, tmp_path, capsys, monkeypatch):
    import io

    from veilspark.plans import egress_job

    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.json").write_text(json.dumps({"ts": 1.0, "real_to_token": {}, "token_to_real": {"⟦א_1⟧": "real"}, "counters": {}}), encoding="utf-8")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("⟦א_1⟧", encoding="utf-8")
    vaults = ["--vaults", str(tmp_path / "v" / "*.json")]
    args = [str(tmp_path / "t"), *vaults, "--out", str(tmp_path / "o"), "--audit", str(tmp_path / "log")]
    assert egress_job.main(args, spark) == 0 and (tmp_path / "o" / "a.txt").read_text(encoding="utf-8") == "real"
    (tmp_path / "t" / "b.txt").write_text("⟦z_1⟧", encoding="utf-8")
    assert egress_job.main(args, spark) == 2 and "b.txt" in capsys.readouterr().err
    assert egress_job.main([str(tmp_path / "t"), *vaults], spark) == 2 and (tmp_path / "t" / "a.txt").read_text(encoding="utf-8") == "real"
    monkeypatch.setattr("sys.stdin", io.StringIO("to ⟦א_1⟧ ⟦z_2⟧"))
    capsys.readouterr()
    assert egress_job.main(["-", *vaults, "--audit", str(tmp_path / "log")], spark) == 0
    said = capsys.readouterr()
    assert said.out == "to real ⟦z_2⟧" and "⟦z_2⟧" in said.err
    assert sorted((r["where"], *r.tokens) for r in spark.read.json(str(tmp_path / "log")).collect()) == [("file:b.txt", "⟦z_1⟧"), ("stdin", "⟦z_2⟧")]
    rows = spark.createDataFrame([("⟦א_1⟧ ⟦z_1⟧", MAP)], "text string, tokens map<string,string>")
    sent, lines = egress.restore_for_send(rows, "mail")
    assert sent.first().sent == "real ⟦z_1⟧" and lines.first()["where"] == "mail"

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspark.functions import text as X
from veilspark.operators import detect, engine, guard, mask, ner, restore, vault
from veilspark.plans import qa, storage
from veilspark.sources import entities, profile, vaults

MENTION = "vault_key string, seq long, start int, entity_type string, real string"


def sequential(rows, known=None):
    """Numbers values one after the other, as they come."""
    book, counts = dict(known or {}), {}
    for key, _ in book:
        pass
    for (key, _), (token, kind, n) in book.items():
        counts[key, kind.replace("_", "")] = max(n, counts.get((key, kind.replace("_", "")), 0))
    for key, _, _, kind, real in sorted(rows, key=lambda r: (r[1], -r[2])):
        if (key, real) not in book:
            safe = kind.replace("_", "")
            counts[key, safe] = counts.get((key, safe), 0) + 1
            book[key, real] = (f"⟦{safe}_{counts[key, safe]}⟧", kind, counts[key, safe])
    return book


def as_dict(df):
    return {(r.vault_key, r.real): (r.token, r.entity_type, r.n) for r in df.collect()}


def test_assignment_equals_loop(spark):
    rng = random.Random(8)
    rows = list({(k, s, a): (k, s, a, rng.choice(["A_B", "AB", "C"]), rng.choice("pqrstuvw")) for k in "xy" for s in range(40) for a in range(0, 30, 10)}.values())
    df = spark.createDataFrame(rows, MENTION)
    assert as_dict(vault.assign(df)) == sequential(rows)
    assert as_dict(vault.assign(df, one_task=1)) == sequential(rows)  # ranks summed over ranges
    early = [r for r in rows if r[1] < 20]
    book = vault.assign(spark.createDataFrame(early[:30], MENTION))
    assert as_dict(vault.extend(df, book)) == sequential(rows, sequential(early[:30]))


def test_mask_round_trip_and_leaks(spark):
    rng = random.Random(4)
    ids = qa.valid_ids(30)
    items = [*ids, "052-7654321", "a@b.co.il", "4111111111111111", "אילת ארז", "תיק 7654"]
    rows = [("s", i, " ".join(rng.choice([*items, "מילה", "ועוד", "7", "\n"]) for _ in range(rng.randint(0, 25)))) for i in range(80)] + [("s", 80, None), ("t", 0, "")]
    messages = spark.createDataFrame(rows, "vault_key string, seq long, text string")
    names = entities.from_callable(spark, lambda: [("אילת ארז", "לקוח")])
    masked, book = mask.mask(messages, names=names)
    out = {(r.vault_key, r.seq): r.masked for r in masked.collect()}
    secrets = [*ids, "052-7654321", "a@b.co.il", "4111111111111111", "אילת ארז"]
    assert not any(s in (t or "") for t in out.values() for s in secrets)
    back = restore.restore_by_join(masked.select("vault_key", "seq", F.col("masked").alias("text")), book)
    assert {(r.vault_key, r.seq): r.restored for r in back.collect()} == {(k, s): t for k, s, t in rows}
    leaks = {r.vault_key: r.n_present for r in vault.present(masked.select("vault_key", F.col("masked").alias("text")), book).collect()}
    assert leaks == {"s": 0}
    reals = {r.real for r in book.collect()}
    everything = " ".join(t or "" for _, _, t in rows)
    present = {r.vault_key: r.n_present for r in vault.present(messages, book).collect()}
    assert present == {"s": sum(r in everything for r in reals)}


def test_same_value_keeps_its_first_type(spark):
    v = qa.valid_ids(1)[0]
    masked, book = mask.mask(spark.createDataFrame([("s", 0, f"ח.פ {v} ואז {v}")], "vault_key string, seq long, text string"))
    text = masked.first().masked
    assert text == "ח.פ ⟦מזהה_1⟧ ואז ⟦מזהה_1⟧"  # numbering runs from the right


def test_instruction(spark):
    rows = [("a", 0, "system", "base"), ("a", 1, "user", "x"), ("b", 0, "user", "y"), ("c", 0, "user", "z"), ("b", 1, "system", None)]
    chat = spark.createDataFrame(rows, "vault_key string, seq long, role string, masked string")
    book = spark.createDataFrame([("a",), ("b",)], "vault_key string")
    out = {(r.vault_key, r.seq): (r.role, r.masked) for r in mask.instruct(chat, book).collect()}
    assert out["a", 0][1] == mask.INSTRUCTION + "\n\nbase" and out["b", -1] == ("system", mask.INSTRUCTION)
    assert len(out) == 6 and out["c", 0] == ("user", "z") and out["b", 1] == ("system", None)


def test_report(spark):
    book = spark.createDataFrame([("s", "⟦a_1⟧", 'x"y\\z'), ("s", "⟦a_2⟧", "plain")], "vault_key string, token string, real string")
    args = json.dumps({"⟦a_2⟧": ["⟦a_1⟧", 3, None], "t": {"u": "⟦a_2⟧ ⟦b_9⟧"}}, ensure_ascii=False)
    rows = spark.createDataFrame([("s", 1, "say ⟦a_2⟧ ⟦q_1⟧ ⟦q_1⟧", [args, "⟦a_2⟧ no json"]), ("t", 1, "⟦a_1⟧", None)], "vault_key string, seq long, content string, arguments array<string>")
    out = {r.vault_key: r for r in restore.report(rows, book).collect()}
    assert out["s"].content == "say plain ⟦q_1⟧ ⟦q_1⟧" and out["s"].leftover == ["⟦q_1⟧", "⟦b_9⟧"] and out["s"].restored_any
    assert json.loads(out["s"].arguments[0]) == {"⟦a_2⟧": ['x"y\\z', 3, None], "t": {"u": "plain ⟦b_9⟧"}} and out["s"].arguments[1] == "plain no json"
    assert not out["t"].restored_any and out["t"].leftover == ["⟦a_1⟧"]
    exact = spark.createDataFrame([(args, {"⟦a_1⟧": 'x"y\\z', "⟦a_2⟧": "plain"})], "t string, m map<string,string>")
    assert json.loads(exact.select(restore.restore_json(F.col("t"), F.col("m"))).first()[0]) == json.loads(out["s"].arguments[0])


def test_vault_files(spark, tmp_path):
    doc = {"ts": 1.0, "real_to_token": {"r": "⟦a_1⟧"}, "token_to_real": {"⟦a_1⟧": "r"}, "counters": {"a": 1}}
    (tmp_path / "b.json").write_text(json.dumps(doc), encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps({**doc, "token_to_real": {"⟦a_1⟧": "first", "⟦a_2⟧": "x"}}), encoding="utf-8")
    (tmp_path / "c.json").write_text("{ broken", encoding="utf-8")
    merged = {r.token: r.real for r in vaults.token_map(spark, str(tmp_path / "*.json")).collect()}
    assert merged == {"⟦a_1⟧": "first", "⟦a_2⟧": "x"}
    old = tmp_path / "b.json"
    os.utime(old, (1, 1))
    assert {r.real for r in vaults.read_files(spark, str(tmp_path / "*.json")).collect()} == {"first", "x"}
    book = spark.createDataFrame([("s", "r", "⟦a_1⟧", "a", 1)], "vault_key string, real string, token string, entity_type string, n int")
    name, value = vaults.as_documents(book).first()
    assert len(name) == 21 and json.loads(value)["token_to_real"] == {"⟦a_1⟧": "r"}
    table = tmp_path / "table"
    assert vaults.load(spark, str(table)) is None and vaults.save(book, str(table))
    assert vaults.load(spark, str(table)).count() == 1
    assert not vaults.save(book, str(table), vaults.load(spark, str(table)))  # nothing new
    more = book.unionByName(book.withColumns({"real": F.lit("q"), "token": F.lit("⟦a_2⟧"), "n": F.lit(2)}))
    assert vaults.save(more, str(table), vaults.load(spark, str(table))) and vaults.load(spark, str(table)).count() == 2
    assert sorted(p.name for p in table.iterdir()) == ["version=000000000", "version=000000001"]
    buckets = {p.name for p in (table / "version=000000001").iterdir() if p.is_dir()}
    assert buckets == {"bucket=04"}  # of the hash of the key, not the key
    assert table.stat().st_mode & 0o077 == 0
    assert vaults.load(spark, str(table), now=4e9).count() == 0
    assert vaults.clear(book, ["s"]).count() == 0 and vaults.clear(book, []).count() == 1
    vaults.write_files(book, str(tmp_path / "files"))
    assert [(r.token, r.real) for r in vaults.read_files(spark, str(tmp_path / "files") + "/*").collect()] == [("⟦a_1⟧", "r")]
    assert (tmp_path / "files").stat().st_mode & 0o077 == 0


def test_modes_and_alerts(spark, tmp_path):
    messages = spark.createDataFrame([("s", 0, "a@b.co.il")], "vault_key string, seq long, text string")
    assert guard.mode_of(" Enforce\n") == "enforce" and guard.mode_of("?") == "off" == guard.mode_of(None)
    sent, book, audit = guard.outbound(messages, "off")
    assert sent.first().sent == "a@b.co.il" and book is None
    sent, _, audit = guard.outbound(messages, "shadow")
    assert sent.first().sent == "a@b.co.il" and audit.first().entities == {"מייל": 1}
    sent, _, audit = guard.outbound(messages, "enforce")
    assert sent.first().sent == "⟦מייל_1⟧" and audit.first().real_values_in_outbound == 0
    rows = spark.createDataFrame([("s", None, ["x", "y"]), ("t", "E", []), ("u", None, [])], "session_id string, error string, leftover array<string>")
    events, seen, lines = guard.alerts(rows), [], []
    guard.flush(events, [guard.collecting_sink(seen), guard.callback_sink(lines.append), guard.file_sink(str(tmp_path / "audit"))])
    assert {(e.kind, e.session_id, e.detail) for e in seen} == {("leftover_token", "s", "x,y"), ("restore_error", "t", "E")}
    assert "[veilspark] restore_error (session t): E" in lines and spark.read.json(str(tmp_path / "audit")).count() == 2


def test_recognizers(spark):
    def broken():
        raise OSError("down")

    def odd(text):
        if "odd" in text:
            raise ValueError(text)
        return [{"start": 0, "end": 3, "entity_type": "לקוח", "text": text[:3]}]

    messages = spark.createDataFrame([("s", 0, "abc a@b.co.il"), ("s", 1, "odd a@b.co.il"), ("s", 2, None)], "vault_key string, seq long, text string")

    def run(load, key):
        masked, book = mask.mask(messages, secondary=ner.recognizer(load, key))
        events = guard.outbound_alerts(masked.withColumnRenamed("masked", "sent"))
        return [r.masked for r in masked.orderBy("seq").collect()], sorted((e.kind, e.detail) for e in events.collect())

    mail = "⟦מייל_1⟧"
    assert run(lambda: ner.one_by_one(odd), "odd") == ([f"⟦לקוח_1⟧ {mail}", f"odd {mail}", None], [("recognizer_error", "ValueError('odd a@b.co.il')")])
    texts, events = run(broken, "broken")
    assert texts == [f"abc {mail}", f"odd {mail}", None] and [k for k, _ in events] == ["recognizer_error"] * 2
    assert run(ner.service("http://127.0.0.1:1", enabled=False), "off") == ([f"abc {mail}", f"odd {mail}", None], [])
    assert len(run(ner.service("http://127.0.0.1:1"), "nobody there")[1]) == 2


def test_service(spark):
    """Requests to a service that counts them: each distinct text of a batch is asked about once."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["text"]
            asked.append((self.path, text))
            body = json.dumps({"spans": [{"start": 0, "end": 3, "entity_type": "לקוח", "text": text[:3]}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rows = [("s", i, t) for i, t in enumerate(["Ada went", "Bob stays", "Ada went"])]
    messages = spark.createDataFrame(rows, "vault_key string, seq long, text string").coalesce(1)
    masked, _ = mask.mask(messages, secondary=ner.recognizer(ner.service(url), url), once=True)
    assert [r.masked for r in masked.orderBy("seq").collect()] == ["⟦לקוח_1⟧ went", "⟦לקוח_2⟧ stays", "⟦לקוח_1⟧ went"]
    assert sorted(set(asked)) == [("/recognize", "Ada went"), ("/recognize", "Bob stays")]
    server.shutdown()


def test_failing_rows(spark):
    def touchy(text):
        if "bad" in text:
            raise ValueError("bad")
        return detect.spans_of(text)

    messages = spark.createDataFrame([("s", 0, "a@b.co.il"), (None, 1, "bad a@b.co.il")], "vault_key string, seq long, text string")
    for closed, kind, text in ((False, "unfiltered_sent", "bad a@b.co.il"), (True, "withheld", None)):
        sent, _, _ = guard.outbound(messages, "enforce", primary=detect.attempted(touchy), closed=closed)
        assert {r.seq: r.sent for r in sent.collect()} == {0: "⟦מייל_1⟧", 1: text}
        assert [tuple(e) for e in guard.outbound_alerts(sent).collect()] == [(kind, "default", "ValueError('bad')")]


def test_keyless_and_repeated_rows(spark):
    text = "mail a@b.co.il now"
    rows = [(None, None, text), (None, 1, text), ("", 1, text), ("s", 1, text), ("s", 1, text), ("s", None, "c@d.co.il a@b.co.il")]
    messages = spark.createDataFrame(rows, "vault_key string, seq long, text string")
    masked, book = mask.mask(messages)
    out = [r.masked for r in masked.collect()]
    assert sorted(out) == sorted(["mail ⟦מייל_1⟧ now"] * 3 + ["mail ⟦מייל_1⟧ now"] * 2 + ["⟦מייל_2⟧ ⟦מייל_1⟧"])
    assert {(r.vault_key, r.real) for r in book.collect()} == {("default", "a@b.co.il"), ("s", "a@b.co.il"), ("s", "c@d.co.il")}
    back = restore.restore_by_join(masked.drop("text"), book, "masked")
    assert sorted(r.restored for r in back.collect()) == sorted(r[2] for r in rows)
    assert {r.vault_key: r.n_present for r in vault.present(masked.select("vault_key", F.col("masked").alias("text")), book).collect()} == {"default": 0, "s": 0}
    assert {r.vault_key: r.n_present for r in vault.present(messages, book).collect()} == {"default": 1, "s": 2}


def test_leaks_of_long_and_short_values(spark):
    long = "v" * 300_000
    values = ["é", "ab", "needle in a", "xyz" * 50, long + "w", "never there"]
    text = "q" * (vault.PIECE - 5) + "needle in a" + "é" * 3 + "xyz" * 60 + long + "w"
    book = spark.createDataFrame([("s", v) for v in values], "vault_key string, real string")
    texts = spark.createDataFrame([("s", text), ("s", "cab"), ("t", "never there"), ("s", None), ("s", "")], "vault_key string, text string")
    assert {r.vault_key: r.n_present for r in vault.present(texts, book).collect()} == {"s": 5}


def test_scratch_is_removed(spark, tmp_path):
    messages = spark.createDataFrame([("s", 0, "a@b.co.il")], "vault_key string, seq long, text string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    with storage.scratch(spark):
        masked, _ = mask.mask(messages)
        assert masked.first().masked == "⟦מייל_1⟧"
        new = set(os.listdir(folder)) - before
        assert new and all(Path(folder, n).stat().st_mode & 0o077 == 0 for n in new)
    assert set(os.listdir(folder)) == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        session = Fake(conf=Fake(get=lambda key, default=None: None), sparkContext=Fake(master=master))
        with pytest.raises(ValueError):
            storage.shared_dir(session)
    alone = Fake(conf=Fake(get=lambda key, default=None: "file:/w" if "warehouse" in key else None), sparkContext=Fake(master="local[4]"))
    assert storage.shared_dir(alone).startswith("file:/w/_shared/")


def test_engine_from_control_files(spark, tmp_path):
    (tmp_path / "MODE").write_text(" Enforce\n")
    (tmp_path / "gazetteer.txt").write_text("אילת ארז\tלקוח\nרשות הרישוי\tמוסד\n", encoding="utf-8")
    (tmp_path / "profile.yaml").write_text(json.dumps({"profile": "x", "never_mask": ["רשות הרישוי"], "token_instruction": False}))
    (tmp_path / "ner_url").write_text("http://127.0.0.1:1")
    (tmp_path / "ner.ctl").write_text("off")
    folder = str(tmp_path)
    messages = spark.createDataFrame([("s", 0, "user", "אילת ארז מול רשות הרישוי"), ("t", 0, "user", "אילת ארז")], "vault_key string, seq long, role string, text string")
    send = engine.live(spark, folder, agent="me")
    assert sorted(r.sent for r in messages.transform(send).collect()) == ["⟦לקוח_1⟧", "⟦לקוח_1⟧ מול רשות הרישוי"]
    (tmp_path / "MODE").write_text("off")
    assert sorted(r.sent for r in messages.transform(send).collect()) == ["אילת ארז", "אילת ארז מול רשות הרישוי"]
    again = engine.Engine.of(spark, folder, agent="me")
    replies = spark.createDataFrame([("u", "⟦לקוח_1⟧ ⟦לקוח_7⟧", None)], "vault_key string, content string, arguments array<string>")
    out, audit, events = again.restore(replies)
    assert out.first().content == "אילת ארז ⟦לקוח_7⟧" and audit.first().leftover == 1
    assert [tuple(e) for e in events.collect()] == [("leftover_token", "me", "⟦לקוח_7⟧")]
    (tmp_path / "vault_mode").write_text("memory")
    memory = engine.Engine.of(spark, folder, agent="me")
    assert memory.known() is None
    memory.sanitize(messages)
    assert memory.known().count() == 1 and memory.vaults is None
    (tmp_path / "profile.yaml").write_text("")
    explained = engine.Engine.of(spark, folder).sanitize(messages)[0]
    assert sorted(r.sent for r in explained.where("seq = -1").collect()) == [mask.INSTRUCTION] * 2


def test_profile():
    assert profile.Profile.of(None) == profile.Profile()
    p = profile.Profile.of({"profile": "x", "never_mask": ["a"], "alerts": {"on": ["z"]}, "other": 1})
    assert (p.name, p.never_mask, p.alerts_on, p.token_instruction) == ("x", ("a",), ("z",), True)


def test_qa(spark):
    rows = qa.verdicts(spark).collect()
    assert len(rows) > 70 and all(r.passed and r.reversible for r in rows)


def test_variants_and_tokens(spark):
    df = spark.createDataFrame([("לדוד ⟦⟦x_1⟧ ⟦a_b_1⟧ ⟦a_01⟧",)], "t string")
    assert df.select(X.find_tokens(F.col("t"))).first()[0] == ["⟦⟦x_1⟧", "⟦a_01⟧"]


def test_inbound_and_hooks(spark):
    book = spark.createDataFrame([("s", "⟦a_1⟧", "real", "a", 1)], "vault_key string, token string, real string, entity_type string, n int")
    rows = spark.createDataFrame([("s", 1, "⟦a_1⟧ ⟦b_1⟧", ['{"k": "⟦a_1⟧"}'])], "vault_key string, seq long, content string, arguments array<string>")
    assert guard.inbound(rows, book, "shadow") == (rows, None, None)
    out, audit, events = guard.inbound(rows, book, "enforce")
    assert out.first().content == "real ⟦b_1⟧" and out.first().arguments == ['{"k": "real"}'] and out.columns == rows.columns
    assert (audit.first().restored, audit.first().leftover) == (True, 1) and events.first().detail == "⟦b_1⟧"
    texts = rows.select("vault_key", "seq", F.col("content").alias("text"))
    assert guard.outgoing_text(texts, book, "off").first().restored == "⟦a_1⟧ ⟦b_1⟧" and guard.outgoing_text(texts, book, "enforce").first().restored == "real ⟦b_1⟧"
    messages = spark.createDataFrame([("s", 0, "a@b.co.il")], "vault_key string, seq long, text string")
    assert messages.transform(guard.outbound_hook(lambda: "enforce")).first().sent == "⟦מייל_1⟧"
    assert rows.transform(guard.inbound_hook(lambda: book, lambda: "enforce")).first().content == "real ⟦b_1⟧"

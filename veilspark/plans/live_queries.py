"""Sources, sinks, files and the live path as registered queries, each with the SQL that gives the same rows.

What they read from files or tables of their own, they have written to the shared folder before.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import fixed as L
from ..operators import egress, gazetteer, guard, mask, restore
from ..operators.engine import Engine
from ..sources import entities, vaults
from ..streaming import deltas as S
from .queries import FAMILY, IN_LIST, KNOWN, LAST, LOOKED_UP, PICK, REPLIES, TURNED, duck, listed, made, named, query
from .storage import read, shared_dir

# --- names

LISTED = "SELECT CASE c_custkey % 5 WHEN 0 THEN concat('# ', c_name) WHEN 1 THEN c_name WHEN 2 THEN concat(' ', c_name, ' ', chr(9), ' סוכן ') WHEN 3 THEN '   ' ELSE concat(c_name, chr(9), 'ספק') END AS value FROM {customer}"


@query("SELECT c_name AS surface, CASE c_custkey % 5 WHEN 1 THEN 'לקוח' WHEN 2 THEN 'סוכן' ELSE 'ספק' END AS entity_type FROM customer WHERE c_custkey % 5 NOT IN (0, 3)")
def names_from_file(spark, sf_dir):
    made(spark, sf_dir, LISTED).write.text(path := shared_dir(spark))
    return entities.from_file(spark, path).select("surface", "entity_type")


@query("SELECT s_name AS surface, 'לקוח' AS entity_type FROM supplier WHERE s_name <> ''")
def names_from_database(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return entities.parties(spark, parties=rows).select("surface", "entity_type")


ONE = named(f"concat('כתבנו אל ', {FAMILY}, ' וגם אל ל', {FAMILY}, ' שלנו')")
SINGLE = PICK(range(5), "doc_id % 7 % 5").replace("'", "")


@query(f"""WITH t AS ({duck(ONE)}) SELECT doc_id, CAST(9 AS BIGINT) AS start_at, f AS value FROM t WHERE {SINGLE} < 3
UNION ALL SELECT doc_id, CAST(9 + length(f) + 9 AS BIGINT), f FROM t WHERE {SINGLE} < 3""")
def gazetteer_single(spark, sf_dir):
    names = entities.from_callable(spark, lambda: [(n, L.CLIENT) for n in LAST[:3]])
    rows = gazetteer.find_names(made(spark, sf_dir, ONE).select("doc_id", "text"), names).select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.text").alias("value"))


@query(f"WITH t AS ({duck(TURNED)}) SELECT doc_id, CAST(3 AS BIGINT) AS start_at, '{L.CLIENT}' AS entity_type, concat(f, ', ', g) AS value FROM t WHERE {IN_LIST}")
def gazetteer_of_any_size(spark, sf_dir):
    """The list stays distributed, as one that is too large to send."""
    found = gazetteer.find_names(made(spark, sf_dir, TURNED).select("doc_id", "text"), listed(spark), most=0)
    rows = found.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start_at"), F.col("s.entity_type").alias("entity_type"), F.col("s.text").alias("value"))


# --- vaults


@query(f"SELECT token, real FROM ({duck(KNOWN)})")
def vault_files(spark, sf_dir):
    """Written as documents, dealt over several for a vault, and read back."""
    vaults.put(vaults.as_documents(made(spark, sf_dir, KNOWN), most=7), path := shared_dir(spark))
    return vaults.read_files(spark, path + "/*").select("token", "real")


@query(f"SELECT substr(sha256(vault_key), 1, 16) AS file_key, count(*) AS n_values, max(n) AS last FROM ({duck(KNOWN)}) GROUP BY ALL")
def vault_documents(spark, sf_dir):
    docs = vaults.as_documents(made(spark, sf_dir, KNOWN))
    kept = F.from_json("value", "real_to_token map<string,string>, counters map<string,int>")
    return docs.select(F.split("name", "[.]")[0].alias("file_key"), F.size(kept["real_to_token"]).cast("long").alias("n_values"), F.element_at(kept["counters"], "לקוח").alias("last"))


@query(f"SELECT vault_key, real, token, entity_type, n, false AS written_again FROM ({duck(KNOWN)})")
def vault_table(spark, sf_dir):
    """Saved in two versions, of which the second adds values; a third with nothing new is not written."""
    book, path = made(spark, sf_dir, KNOWN), shared_dir(spark)
    vaults.save(book.where("n % 2 = 0"), path)
    vaults.save(book, path, vaults.load(spark, path))
    again = vaults.save(book, path, vaults.load(spark, path))
    return vaults.load(spark, path).withColumn("written_again", F.lit(again))


@query(f"SELECT vault_key, real FROM ({duck(KNOWN)}) WHERE vault_key NOT IN ('s1', 's4')")
def vault_clear(spark, sf_dir):
    return vaults.clear(made(spark, sf_dir, KNOWN), ["s1", "s4"]).select("vault_key", "real")


@query(f"SELECT r.vault_key, seq, count(x.real) + count(y.real) > 0 AS any_known, EXISTS (SELECT 1 FROM ({duck(KNOWN)}) k WHERE k.vault_key = r.vault_key) AS restored_any {LOOKED_UP} GROUP BY ALL")
def vault_holds_any(spark, sf_dir):
    rows = made(spark, sf_dir, REPLIES).select("vault_key", "seq", F.col("text").alias("content"), F.array("a", "b").alias("arguments"))
    told = restore.report(rows, made(spark, sf_dir, KNOWN))
    return told.select("vault_key", "seq", (F.size("leftover") < 3).alias("any_known"), "restored_any")


# --- outgoing contents

NOTES = "SELECT n_nationkey AS k, concat('to ⟦לקוח_', CAST(n_nationkey AS STRING), '⟧', chr(10), '⟦⟦x_1⟧') AS text FROM {nation}"
MAP = "SELECT concat('⟦לקוח_', CAST(n_nationkey AS STRING), '⟧') AS token, n_name AS real FROM {nation} WHERE n_nationkey % 3 > 0"
FILE = f"SELECT k, n.text, m.real FROM ({duck(NOTES)}) n LEFT JOIN ({duck(MAP)}) m ON m.token = concat('⟦לקוח_', CAST(k AS VARCHAR), '⟧')"


def notes(spark, sf_dir):
    """A file per nation, restored in place: the folder, what was told, and the folder of audit lines."""
    made(spark, sf_dir, NOTES).repartition("k").write.partitionBy("k").text(path := shared_dir(spark))
    told = egress.restore_files(spark, path, made(spark, sf_dir, MAP), audit=(log := shared_dir(spark)))
    return path, told, log


def of_nation():
    return F.regexp_extract("path", "/k=(\\d+)/", 1).cast("int").alias("k")


@query(f"SELECT CAST(k AS INTEGER) AS k, CASE WHEN real IS NULL THEN concat(text, chr(10)) ELSE concat('to ', real, chr(10), '⟦⟦x_1⟧', chr(10)) END AS text FROM ({FILE})")
def egress_files(spark, sf_dir):
    path, _, _ = notes(spark, sf_dir)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(of_nation(), F.col("content").cast("string").alias("text"))


@query(f"SELECT CAST(k AS INTEGER) AS k, real IS NOT NULL AS changed, concat_ws(',', CASE WHEN real IS NULL THEN concat('⟦לקוח_', CAST(k AS VARCHAR), '⟧') END, '⟦⟦x_1⟧') AS leftover FROM ({FILE})")
def egress_files_told(spark, sf_dir):
    _, told, _ = notes(spark, sf_dir)
    return told.where(F.col("path").rlike("/part-[^/]*$")).select(of_nation(), "changed", F.array_join("leftover", ",").alias("leftover"))


@query(f"SELECT 'egress_leftover' AS kind, concat_ws(',', CASE WHEN real IS NULL THEN concat('⟦לקוח_', CAST(k AS VARCHAR), '⟧') END, '⟦⟦x_1⟧') AS tokens FROM ({FILE})")
def egress_files_audit(spark, sf_dir):
    _, _, log = notes(spark, sf_dir)
    return spark.read.json(log).where(F.col("where").startswith("file:part-")).select("kind", F.array_join("tokens", ",").alias("tokens"))


def with_known(spark, sf_dir):
    return restore.with_tokens(made(spark, sf_dir, REPLIES), made(spark, sf_dir, KNOWN), "text")


RESTORED = "concat('אישור: ', coalesce(x.real, a), ' עם ', coalesce(y.real, b), ' ⟦⟦x_1⟧ תם')"
LEFT = "concat_ws(',', CASE WHEN x.real IS NULL THEN a END, CASE WHEN y.real IS NULL THEN b END, '⟦⟦x_1⟧')"


@query(f"SELECT seq, {RESTORED} AS text, {LEFT} AS leftover {LOOKED_UP}")
def egress_content(spark, sf_dir):
    done = with_known(spark, sf_dir).withColumn("r", egress.restore_content(F.col("text"), F.col("tokens")))
    return done.select("seq", "r.text", F.array_join("r.leftover", ",").alias("leftover"))


@query(f"SELECT seq, {RESTORED} AS sent {LOOKED_UP}")
def egress_send(spark, sf_dir):
    return egress.restore_for_send(with_known(spark, sf_dir), "mail")[0].select("seq", "sent")


@query(f"SELECT 'egress_leftover' AS kind, 'mail' AS \"where\", {LEFT} AS tokens {LOOKED_UP}")
def egress_send_audit(spark, sf_dir):
    lines = egress.restore_for_send(with_known(spark, sf_dir), "mail")[1]
    return lines.select("kind", "where", F.array_join("tokens", ",").alias("tokens"))


@query(f"SELECT seq, concat('{{\"to\":\"', a, '\"}}') AS body, false AS changed FROM ({duck(REPLIES)})")
def egress_switched_off(spark, sf_dir):
    rows = with_known(spark, sf_dir).select("seq", "tokens", F.lit("http://h/").alias("url"), F.concat(F.lit('{"to":"'), "a", F.lit('"}')).alias("json"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("map<string,string>").alias("form"))
    return egress.restore_requests(rows, enabled=False).select("seq", F.col("json").alias("body"), "changed")


@query(f"SELECT seq, {RESTORED} AS body, true AS changed {LOOKED_UP}")
def egress_bytes(spark, sf_dir):
    done = with_known(spark, sf_dir).withColumn("r", egress.restore_bytes(F.encode("text", "UTF-8"), F.col("tokens")))
    return done.select("seq", F.col("r.body").cast("string").alias("body"), "r.changed")


@query(f"SELECT seq, concat('{{\"to\": \"', coalesce(x.real, a), '\", \"⟦לקוח_1⟧\": [\"', coalesce(y.real, b), '\", 7]}}') AS arguments {LOOKED_UP}")
def json_exact(spark, sf_dir):
    call = F.concat(F.lit('{"to":"'), "a", F.lit('","⟦לקוח_1⟧":["'), "b", F.lit('",7]}'))
    return with_known(spark, sf_dir).select("seq", restore.restore_json(call, F.col("tokens")).alias("arguments"))


# --- the live path


@query(f"SELECT 'leftover_token' AS kind, r.vault_key AS session_id, {LEFT} AS detail {LOOKED_UP}")
def alert_log(spark, sf_dir):
    """Events appended to a log of JSON lines, and read back."""
    rows = made(spark, sf_dir, REPLIES).select("vault_key", "seq", F.col("text").alias("content"), F.array().cast("array<string>").alias("arguments"))
    _, _, events = guard.inbound(rows, made(spark, sf_dir, KNOWN), "enforce")
    guard.flush(events, [guard.file_sink(path := shared_dir(spark))])
    return spark.read.schema(guard.ALERT).json(path)


@query(f"SELECT seq, {RESTORED} AS restored {LOOKED_UP}")
def outgoing_texts(spark, sf_dir):
    return guard.outgoing_text(made(spark, sf_dir, REPLIES), made(spark, sf_dir, KNOWN), "enforce").select("seq", "restored")


@query(f"SELECT seq, concat('אישור: ', a, ' עם ', b, ' ⟦⟦x_1⟧ תם') AS content FROM ({duck(REPLIES)})")
def inbound_off(spark, sf_dir):
    hook = guard.inbound_hook(lambda: made(spark, sf_dir, KNOWN), lambda: "shadow")
    rows = made(spark, sf_dir, REPLIES).select("vault_key", "seq", F.col("text").alias("content"), F.array().cast("array<string>").alias("arguments"))
    return rows.transform(hook).select("seq", "content")


PHONES = "SELECT CAST(conv_id AS STRING) AS vault_key, CAST(turn AS BIGINT) AS seq, role, concat('⟩', CAST(conv_id * 7919 % 1000 AS STRING), ' ארז נבון mail u', CAST(conv_id AS STRING), '@example.org') AS text FROM {conversations}"


@query(f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY vault_key ORDER BY CASE WHEN role = 'system' THEN seq END NULLS LAST) AS r, max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY vault_key) AS sys FROM ({duck(PHONES)})),
m AS (SELECT *, regexp_replace(text, 'u[0-9]+@example.org', '⟦מייל_1⟧') AS masked FROM t)
SELECT vault_key, seq, role, length(masked) + CASE WHEN role = 'system' AND r = 1 THEN {{lead}} ELSE 0 END AS n_chars, masked NOT LIKE '%@%' AS clean FROM m
UNION ALL SELECT vault_key, CAST(-1 AS BIGINT), 'system', CAST({{lead}} - 2 AS BIGINT), true FROM t WHERE sys = 0 GROUP BY vault_key""".replace("{lead}", str(len(mask.INSTRUCTION) + 2)))
def engine_sanitize(spark, sf_dir):
    """An engine built from control files: a profile that never masks a listed name, and a vault that is saved."""
    folder = shared_dir(spark)
    spark.createDataFrame([("ארז נבון\tלקוח",)], "value string").coalesce(1).write.text(f"{folder}/{L.NAMES_FILE}")
    spark.createDataFrame([(json.dumps({"profile": "p", "never_mask": ["ארז נבון"]}),)], "value string").coalesce(1).write.text(f"{folder}/{L.PROFILE_FILE}")
    sent, _, _ = Engine.of(spark, folder).sanitize(made(spark, sf_dir, PHONES))
    return sent.select("vault_key", "seq", "role", F.length("sent").cast("long").alias("n_chars"), (~F.contains("sent", F.lit("@"))).alias("clean"))


@query(f"SELECT DISTINCT 'agent' AS vault_key, concat('u', vault_key, '@example.org') AS real FROM ({duck(PHONES)})")
def engine_agent_vault(spark, sf_dir):
    """All sessions of an agent share one vault, which goes on from what was saved."""
    folder = shared_dir(spark)
    first = Engine(spark, vaults=folder, agent="agent")
    first.sanitize(made(spark, sf_dir, PHONES).where("CAST(vault_key AS BIGINT) % 2 = 0"))
    second = Engine(spark, vaults=folder, agent="agent")
    second.sanitize(made(spark, sf_dir, PHONES))
    return vaults.load(spark, folder).select("vault_key", "real")


@query(f"SELECT seq AS turn, concat('אישור: ', coalesce(x.real, a), ' ⟦או') AS text {LOOKED_UP}")
def stream_flush(spark, sf_dir):
    """A turn that ends within a mark: what is still held is sent with the last delta."""
    text = F.concat(F.lit("אישור: "), "a", F.lit(" ⟦או"))
    parts = made(spark, sf_dir, REPLIES).select(F.col("vault_key").alias("session_id"), F.col("seq").alias("turn"), F.posexplode(F.regexp_extract_all(text, F.lit("(?s).{1,4}"), F.lit(0))).alias("delta_idx", "text"))
    back = S.restored_deltas(S.hold_back(parts, flush=True), made(spark, sf_dir, KNOWN))
    return S.joined_replies(back).select("turn", "text")

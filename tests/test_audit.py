"""Audit records, signatures, chains, corpora and streams."""

import hashlib
import hmac
import json
from datetime import datetime, timedelta
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from palinode.functions.config import Config
from palinode.operators import audit
from palinode.operators.pipeline import Normalizer
from palinode.plans.oracle import oracle_sql
from palinode.plans.queries import queries
from palinode.sources.corpus import append_lines, read_corpus, read_lines
from palinode.sources.shared import shared_folder, table, written
from palinode.streaming.scan import audit_stream, chain_stream

KEY = b"secret"


def made(spark, texts):
    df = spark.createDataFrame([(k, "a" if k % 3 else "b", t) for k, t in enumerate(texts)], "k int, app string, text string")
    few = Normalizer(["bidi-control", "fullwidth-chars", "cjk-superposition", "split-string"])
    return audit.records(few.analyze(df), at=audit.iso_utc(F.col("k").cast("bigint") * 86_400))


def test_records(spark):
    rows = made(spark, ["ignore‮all", "plain", "中文字句ignore句子词", None]).orderBy("k").collect()
    first = rows[0]
    assert first["input_hash"] == hashlib.sha256("ignore‮all".encode()).hexdigest() and first["input_len"] == 10
    assert first["passes_fired"] == ["bidi-control"] and first["blocked"] and first["timestamp"] == "1970-01-01T00:00:00Z"
    d = first["detections"][0]
    assert (d["pass"], d["original_len"], d["normalized_len"]) == ("bidi-control", 10, 9)
    assert rows[1]["passes_fired"] == [] and not rows[1]["blocked"] and rows[2]["halted"] and rows[2]["obfuscation_score"] == 1.0
    assert rows[3]["input_hash"] is None
    line = json.loads(made(spark, ["ignore‮all"]).select(audit.to_line()).first()[0])
    assert list(line) == list(audit.FIELDS) and line["signature"] is None and "ignore" not in json.dumps(line["detections"][0])


def test_lines_for_people(spark):
    text = made(spark, ["ignore\u202eall \"é\""]).select(audit.to_pretty()).first()[0]
    line = json.loads(text)
    assert list(line) == list(audit.FIELDS) and text.startswith('{\n  "input_hash" : "') and line["passes_fired"] == ["bidi-control"]


def test_times_and_cuts(spark):
    seconds = [0, 951_782_400, 1_700_000_000, -1]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in seconds], "s bigint").select(audit.iso_utc(F.col("s"))).collect()]
    assert got == ["1970-01-01T00:00:00Z", "2000-02-29T00:00:00Z", "2023-11-14T22:13:20Z", "1969-12-31T23:59:59Z"]
    texts = ["x" * 200, "x" * 201, "é" * 150, "x" + "語" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(audit.truncated(F.col("t"))).collect()]
    assert got[0] == texts[0] and all(len(g.encode()) <= 203 and g.endswith("...") for g in got[1:]) and got[3] == "x" + "語" * 66 + "..."


def in_words(seconds):
    """The time from the same day of a year that datetime knows, 400 years being a cycle."""
    cycles, within = divmod(seconds, 146_097 * 86_400)
    at = datetime(1970, 1, 1) + timedelta(seconds=within)
    year = at.year + 400 * cycles
    return (f"{year:04}" if year >= 0 else str(year)) + at.strftime("-%m-%dT%H:%M:%SZ")


def test_times_of_far_years(spark):
    known = [253_402_300_799, 253_402_300_800, -62_135_596_801, -62_167_219_200, -62_167_219_201]
    assert [*map(in_words, known)] == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "0000-12-31T23:59:59Z", "0000-01-01T00:00:00Z", "-1-12-31T23:59:59Z"]
    seconds = [*known, *(s * 86_400 + e for s in (2**31, -(2**31) - 1, 10**13, -(10**13)) for e in (-1, 0, 1)), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(s,) for s in [*seconds, None]], "s bigint")
    for kind in ("bigint", "decimal(26,0)"):
        got = {r["s"]: r["t"] for r in df.select("s", audit.iso_utc(F.col("s").cast(kind)).alias("t")).collect()}
        assert got == {s: in_words(s) for s in seconds} | {None: None}


def test_log_times_of_large_numbers(spark, tmp_path):
    sql = [k + e for k in (2_932_898, 10**7, 10**8, -719_163, -(10**6)) for e in range(-400, 400)]
    beyond = [*(s * 2**e for s in (1, -1) for e in (27, 31, 32, 47, 62)), 2**63 - 1, -(2**63)]  # here the SQL gives up
    spark.createDataFrame([(k,) for k in [*sql, *beyond]], "record_id bigint").write.parquet(str(tmp_path / "audit_record.parquet"))
    got = {r["record_id"]: r["written_at"] for r in queries()["log_times"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"create view audit_record as select * from '{tmp_path}/audit_record.parquet/*.parquet' where abs(record_id::hugeint) < 106000000")
    want = dict(db.execute(oracle_sql()["log_times"]).fetchall())
    assert len(want) == len(sql) and got == want | {k: in_words(k * 86_413 - 100_000_000) for k in beyond}


def test_a_cluster_must_name_its_shared_folder():
    def session(master):
        context = SimpleNamespace(getConf=lambda: {}, master=master, applicationId=master)
        return SimpleNamespace(conf={}, sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,3000]", "k8s://host"):
        with pytest.raises(ValueError):
            shared_folder(session(master))
    assert shared_folder(session("local[8]")) and shared_folder(session("local"))


def test_signatures(spark):
    signed = audit.sign(made(spark, ["a‮b", "c"]), KEY)
    row = signed.select("signature", audit._message().alias("m")).first()
    assert row["signature"] == hmac.new(KEY, row["m"].encode(), hashlib.sha256).hexdigest()
    ok = lambda df, key=KEY: {r[0] for r in audit.verify(df, key).select("verified").collect()}
    assert ok(signed) == {True} and ok(signed, b"other") == {False}
    assert ok(signed.withColumn("signature", F.upper("signature"))) == {True}
    assert ok(signed.withColumn("blocked", ~F.col("blocked"))) == {False} == ok(signed.withColumn("prev_hmac", F.lit("x")))
    assert ok(signed.withColumn("signature", F.lit("zz"))) == {False} == ok(signed.withColumn("signature", F.lit(None).cast("string")))
    long = b"k" * 100
    got = spark.range(1).select(audit.hmac_sha256(F.lit("é"), long)).first()[0]
    assert got == hmac.new(long, "é".encode(), hashlib.sha256).hexdigest()


def test_chains(spark):
    rows = made(spark, [f"text {k}‮" for k in range(20)]).select("k", "app", *audit.FIELDS)
    chained = audit.chain(rows.repartition(5), KEY, "app", "k")
    checked = audit.check_links(audit.verify(chained, KEY), "app", "k").collect()
    assert len(checked) == 20 and all(r["verified"] and r["linked"] for r in checked)
    assert sum(r["prev_hmac"] is None for r in checked) == 2
    broken = audit.check_links(chained.where("k <> 4"), "app", "k").where("not linked").collect()
    assert [r["k"] for r in broken] == [5]


def test_lines_and_corpora(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"category":"a","text":"x\\u202ey"}\n\n{"category":"b","text":"z"}\n')
    corpus = read_corpus(spark, str(tmp_path / "c.jsonl"))
    assert sorted(tuple(r) for r in corpus.collect()) == [("a", "x‮y"), ("b", "z")]
    signed = audit.sign(made(spark, ["a‮b", "c"]), KEY)
    append_lines(signed, str(tmp_path / "log"))
    append_lines(signed, str(tmp_path / "log"))
    back = read_lines(spark, str(tmp_path / "log"))
    assert back.count() == 4 and audit.verify(back, KEY).where("verified").count() == 4


def test_streams(spark, tmp_path):
    texts = spark.createDataFrame([(k, "app", f"t{k}‮") for k in range(6)], "k int, app string, text string")
    texts.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(texts.schema).parquet(str(tmp_path / "in"))
    audit_stream(source, Normalizer(["bidi-control"]), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert read_lines(spark, str(tmp_path / "log")).where("blocked").count() == 6
    made_ = audit.records(Normalizer(["bidi-control"], Config()).analyze(source), at=F.lit("now"))
    query = chain_stream(made_, KEY, "app", "k").writeStream.format("memory").queryName("chained").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("select * from chained order by k").collect()
    assert [r["prev_hmac"] for r in rows] == [None, *[r["signature"] for r in rows[:-1]]]


def test_shared_tables(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    assert written(table(spark, str(tmp_path), "t"), "copy").count() == 5 and shared_folder(spark)

"""The jobs over growing input, after failures, and from their command lines."""

import json
import logging
import os
import subprocess
import sys
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import lexicon, normalised
from jobs import queries as jobs
from tests.test_oracle import DATA, rows

ROOT = Path(__file__).resolve().parent.parent
SCHEMA = "doc_id long, text string, lang string, source string, n string, batch string"
FIRST = [
    (1, "L’été, l'ÉTÉ (twice) — été!", "fr", "a", "x", "y"),
    (2, None, "fr", "a", None, None),
    (3, "", "en", "b", None, None),
    (4, "One one TWO\tthree\none", "en", "b", None, None),
    (4, "One one TWO\tthree\none", "en", "b", None, None),
    (5, "one ... --- '' 12", None, "b", None, None),
    (6, "no source", "en", None, None, None),
    (7, "an empty language", "", "a", None, None),
]
SECOND = [(8, "one word more été", "fr", "a", None, None), (9, "one " * 5000, "en", "c", None, None), (10, "a new language", "de", "a", None, None)]


def brute(docs):
    cells = Counter()
    for _, text, lang, source, *_ in docs:
        t = unicodedata.normalize("NFC", text or "")
        for w in "".join("'" if c in "’ʼ‘`´" else c for c in t).lower().split():
            while w and not w[0].isalnum():
                w = w[1:]
            while w and not w[-1].isalnum():
                w = w[:-1]
            if w:
                cells[lang, source, w] += 1
    out = defaultdict(list)
    for (lang, _, w), n in cells.items():
        out[lang, w].append(n)
    return {(lang, w): (sum(x), len(x), min(x), max(x), sum(x) / len(x)) for (lang, w), x in out.items()}


def written(spark, path):
    got = spark.read.parquet(path).collect()
    assert len({(r["lang"], r["word"]) for r in got}) == len(got)
    return {(r["lang"], r["word"]): (r["n"], r["n_sources"], r["least"], r["most"], r["mean"]) for r in got}


@pytest.fixture
def places(tmp_path):
    return {"documents": f"{tmp_path}/documents.parquet", "output": f"{tmp_path}/lexicon", "checkpoint": f"{tmp_path}/checkpoint"}


def arrive(spark, docs, path, files=2):
    spark.createDataFrame(docs, SCHEMA).repartition(files).write.mode("append").parquet(path)


def test_lexicon_takes_only_what_is_new(spark, places, caplog):
    caplog.set_level(logging.INFO, "tessera.jobs")
    arrive(spark, FIRST, places["documents"])
    said = lexicon.run(spark, **places)
    assert said["rows_read"] == len(FIRST) and said["texts_missing"] == 1 and written(spark, places["output"]) == brute(FIRST)
    again = lexicon.run(spark, **places)
    assert again["batches"] == again["rows_read"] == 0 and written(spark, places["output"]) == brute(FIRST)
    arrive(spark, SECOND, places["documents"])
    more = lexicon.run(spark, **places, files_per_batch=1)
    assert more["rows_read"] == len(SECOND) and more["batches"] >= 2
    assert written(spark, places["output"]) == brute(FIRST + SECOND)
    assert more["words_written"] == len(brute(FIRST + SECOND)) and "read 8 rows" in caplog.text and "wrote" in caplog.text
    assert {p.name for p in Path(places["output"]).iterdir() if p.is_dir()} == {f"language={x}" for x in ("fr", "en", "de", "none")}


@pytest.mark.parametrize("where", ["counting", "before its commit", "publishing"])
def test_lexicon_after_a_failure(spark, places, monkeypatch, where):
    arrive(spark, FIRST, places["documents"], 1)
    lexicon.run(spark, **places)
    arrive(spark, SECOND, places["documents"], 1)
    with monkeypatch.context() as m:
        if where == "counting":  # the table to be replaced is already broken
            def broken(docs, *columns):
                docs.sparkSession.createDataFrame([], lexicon.COUNTS).write.mode("overwrite").parquet(f"{places['checkpoint']}/counts/turn=1")
                raise RuntimeError("lost")

            m.setattr(lexicon, "counted", broken)
        elif where == "before its commit":  # the counts are written, the batch isn't marked as done
            def info(*args):
                if "batch" in args[0]:
                    raise RuntimeError("lost")

            m.setattr(lexicon.log, "info", info)
        else:
            def lost(counts):
                raise RuntimeError("lost")

            m.setattr(lexicon, "lexicon", lost)
        with pytest.raises(Exception, match="lost"):
            lexicon.run(spark, **places)
    lexicon.run(spark, **places)
    assert written(spark, places["output"]) == brute(FIRST + SECOND)


def test_lexicon_of_nothing(spark, places):
    spark.createDataFrame([], SCHEMA).write.parquet(places["documents"])
    assert lexicon.run(spark, **places)["words_written"] == 0
    arrive(spark, FIRST, places["documents"])
    lexicon.run(spark, **places)
    assert written(spark, places["output"]) == brute(FIRST)


EVENTS = "event_id long, user_id long, event_type string, value double, ts timestamp"


def observations(n):
    cls = ["click", "view", "error", None, ""]
    out = [(i, i % 3 if i % 11 else None, cls[i % 5], float(i * i % 17 + 1), None) for i in range(n)]
    return [*out, (1001, 7, "click", 5.0, None), (1002, 1, "click", float("nan"), None), (1003, 1, "view", None, None), (1004, 8, "view", 2.0, None), (1005, 8, "view", 2.0, None)]


def expected(rows):
    per = defaultdict(list)
    value = {r[0]: None if r[3] is None or r[3] != r[3] else r[3] for r in rows}
    for r in rows:
        if r[2] not in (None, "error") and value[r[0]] is not None:
            per[r[1]].append(value[r[0]])
    out = {}
    for r in rows:
        x, z = per[r[1]], None
        if len(x) > 1 and r[2] not in (None, "error") and value[r[0]] is not None:
            m = sum(x) / len(x)
            s = (sum((y - m) ** 2 for y in x) / (len(x) - 1)) ** 0.5
            z = round((value[r[0]] - m) / s, 9) + 0.0 if s > 0 else None
        out[r[0]] = z
    return out


def test_normalised_rows_by_class(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "tessera.jobs")
    settings = jobs.configuration(str(jobs.HERE / "normalised.yaml"))
    source, output = f"{tmp_path}/events", f"{tmp_path}/tokens"

    def run(**more):
        return normalised.run(spark, source, output, **settings, **more)

    def now():
        return {r["token_id"]: None if r["f1_norm"] is None else round(r["f1_norm"], 9) + 0.0 for r in spark.read.parquet(output).collect()}

    few, many = observations(60), observations(90)
    spark.createDataFrame(few, EVENTS).write.parquet(source)
    said = run()
    assert said["rows_read"] == said["rows_written"] == len(few) and said["f1_missing"] == 2 and said["unit_missing"] == 6
    assert now() == expected(few)
    assert run() == said and now() == expected(few)
    spark.createDataFrame(many, EVENTS).write.mode("overwrite").parquet(source)
    before = now()
    classes = {r[0]: r[2] or "none" for r in many}
    assert run(classes=["click", "none"])["rows_written"] == sum(x in ("click", "none") for x in classes.values())
    mixed = now()
    want = expected(many)
    assert all(mixed[i] == (want if classes[i] in ("click", "none") else before)[i] for i in mixed)
    run()
    assert now() == want and {p.name for p in Path(output).iterdir() if p.is_dir()} == {"class=click", "class=view", "class=error", "class=none"}
    assert "f1_missing: 2" in caplog.text and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == "STATIC"


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_registered_job(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df, rel = jobs.QUERIES[name](spark, str(DATA)), con.sql(jobs.ORACLES[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(rel.fetchall(), rel.columns)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_command_line(tmp_path):
    env = os.environ | {"PYTHONPATH": str(ROOT), "SPARK_CONF_DIR": str(tmp_path), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    got = subprocess.run([sys.executable, "-m", "jobs.normalised", "--observations", f"{DATA}/events.parquet", "--output", f"{tmp_path}/out"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
    said = json.loads(got.stdout.strip().splitlines()[-1])
    assert said["rows_read"] == said["rows_written"] > 0 and "tessera.jobs wrote" in got.stderr


def test_hot_source_adds_up_before_the_shuffle(spark):
    docs = spark.range(1000).select(F.lit("same words again").alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"))
    plan = lexicon.counted(docs, "text", "lang", "source")._jdf.queryExecution().toString()
    assert "partial_count" in plan

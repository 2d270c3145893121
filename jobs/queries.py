"""The jobs as queries: each runs twice over the whole tables into a new folder, and its output is read back."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import lexicon, normalised
from tessera.plans.roles import TOK_SQL, rounded
from tessera.sources.tables import configuration
from tessera.storage import new_path

HERE = Path(__file__).resolve().parent


def job1_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, settings = new_path(spark, "job1"), configuration(str(HERE / "lexicon.yaml"))
    for _ in range(2):
        lexicon.run(spark, f"{sf_dir}/documents.parquet", f"{top}/lexicon", f"{top}/checkpoint", **settings)
    out = spark.read.parquet(f"{top}/lexicon").select("lang", "word", "n", "n_sources", "least", "most", "mean")
    return rounded(out)


def job2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, settings = new_path(spark, "job2"), configuration(str(HERE / "normalised.yaml"))
    for _ in range(2):
        normalised.run(spark, f"{sf_dir}/events.parquet", f"{top}/tokens", **settings, nan_is_missing=False)
    return rounded(spark.read.parquet(f"{top}/tokens").drop("class"))


QUERIES = {"job1_lexicon": job1_lexicon, "job2_normalised": job2_normalised}

ORACLES = {
    "job1_lexicon": r"""WITH f AS (SELECT lang, source, lower(trim(translate(nfc_normalize(text), '’ʼ‘`´', ''''''''''''), ' ')) AS t FROM documents),
 w AS (SELECT lang, source, regexp_replace(unnest(regexp_split_to_array(t, '[\x20\x09-\x0D]+')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS word FROM f WHERE t IS NOT NULL),
 c AS (SELECT lang, source, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL)
 SELECT lang, word, sum(n)::BIGINT AS n, count(*) AS n_sources, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM c GROUP BY lang, word""",
    "job2_normalised": f"""WITH {TOK_SQL}, st AS (SELECT unit, avg(f1) AS m1, stddev_samp(f1) AS s1, avg(f2) AS m2, stddev_samp(f2) AS s2 FROM tok WHERE fit GROUP BY unit)
 SELECT token_id, t.unit, cls, status, gender, round(f1, 6) AS f1, round(f2, 6) AS f2, round(CASE WHEN fit AND s1 > 0 THEN (f1 - m1) / s1 END, 6) AS f1_norm, round(CASE WHEN fit AND s2 > 0 THEN (f2 - m2) / s2 END, 6) AS f2_norm,
 round(CASE WHEN f1 > 0 THEN 12 * log2(f1 / 100.0) END, 6) AS f1_st FROM tok t LEFT JOIN st ON t.unit IS NOT DISTINCT FROM st.unit""",
}

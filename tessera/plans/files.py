"""Sources and sinks as queries: files that Spark writes from the given tables into the shared folder, read back by the library's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import describe as D
from ..session import table
from ..sources import tables as S
from ..storage import new_path
from .roles import TOK_SQL, frame, rounded, tokens

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[name], ORACLES[name] = run, sql
        return run

    return add


def written(df: DataFrame, label: str, **options) -> str:
    """Where a delimited copy of df with a header lies."""
    path = new_path(df.sparkSession, label)
    df.write.options(header=True, **options).csv(path)
    return path


@query("s1_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s1(spark, d):
    own = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    schema = ", ".join(f"{c} {t}" for c, t in own.dtypes)
    return S.delimited(spark, written(own, "csv"), schema)


@query("s3_unit_metadata", "SELECT 'C' || c_custkey AS unit, CASE WHEN c_custkey % 3 = 0 THEN 'L1' ELSE 'L2' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer")
def s3(spark, d):
    """Units with status and gender from a table with semicolons and untidy cells."""
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(
        F.concat(F.lit(" C"), k, F.lit(" ")).alias("spk"),
        F.when(k % 3 == 0, F.when(k % 2 == 0, " FR ").otherwise("fr")).otherwise("en").alias("L1"),
        F.when(k % 2 == 0, "f ").otherwise("M").alias("Gender"),
    )
    path = written(own, "metadata", sep=";", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return S.unit_metadata(spark, path)


INTERVALS = f"""WITH {TOK_SQL}, i AS (SELECT unit, sub, cls, token_id, row_number() OVER (PARTITION BY unit, sub, cls ORDER BY token_id) - 1 AS pos FROM tok)
 SELECT 'u' || unit AS unit, 'u' || unit || '/' || sub || '/' || cls AS tier, pos, token_id::DOUBLE AS onset, token_id + 0.5 AS fin, CASE WHEN token_id % 4 = 0 THEN '' ELSE cls || ' "' || token_id || '"' END AS label FROM i"""


#: Tiers in one label file, which a task reads whole: more tiers make more files, not larger ones.
TIERS_IN_A_FILE = 2000


def label_files(spark: SparkSession, d: str) -> str:
    """A folder of label files: one tier per unit, hour and class, an interval per token, some without a label."""
    mark = F.when(F.col("token_id") % 4 == 0, "").otherwise(F.concat("cls", F.lit(' ""'), "token_id", F.lit('""')))
    interval = F.concat(F.lit("xmin = "), "token_id", F.lit("\n xmax = "), F.col("token_id") + 0.5, F.lit('\n text = "'), mark, F.lit('"'))
    tiers = tokens(spark, d).withColumn("interval", interval).groupBy("unit", "sub", "cls").agg(F.array_sort(F.collect_list(F.struct("token_id", "interval"))).alias("held"))
    name = F.concat(F.lit("u"), "unit", F.lit("/"), "sub", F.lit("/"), "cls")
    body = F.array_join(F.transform("held", lambda x: x["interval"]), "\n ")
    text = F.concat(F.lit('class = "IntervalTier"\n name = "'), name, F.lit('"\n '), body)
    path = new_path(spark, "labels")
    tiers.select(text.alias("value")).write.option("maxRecordsPerFile", TIERS_IN_A_FILE).text(path)
    return path


def intervals(spark: SparkSession, d: str) -> DataFrame:
    got = S.tiers(spark, label_files(spark, d), "part-*")
    return got.select(F.split_part("tier", F.lit("/"), F.lit(1)).alias("unit"), "tier", F.col("pos").cast("long").alias("pos"), "onset", "fin", "label")


@query("s6_label_tiers", INTERVALS)
def s6(spark, d):
    """Intervals of label files, those without a label among them."""
    return intervals(spark, d)


@query("s5_known_units", f"SELECT * FROM ({INTERVALS}) WHERE unit IN (SELECT 'u' || c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def s5(spark, d):
    """The same, of units that the metadata know."""
    known = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("unit"))
    return S.of_known_units(intervals(spark, d), known, "unit")


@query("k1_csv_table", f"WITH {TOK_SQL} SELECT cls, status, count(*) AS n_tokens, sum((f1 IS NULL)::INT)::BIGINT AS f1_n_missing, round(avg((f1 IS NULL)::INT), 6) AS f1_p_missing FROM tok GROUP BY cls, status")
def k1(spark, d):
    """A result as a delimited table with a header, and no column of row numbers."""
    own = D.missingness(tokens(spark, d), ["cls", "status"], ["f1"])
    return S.delimited(spark, written(own, "table"), ", ".join(f"{c} {t}" for c, t in own.dtypes))


@query("k5_split_by_prefix", "SELECT s_suppkey, s_name, 'with' AS part FROM supplier WHERE s_name LIKE '%0' UNION ALL SELECT s_suppkey, s_name, 'without' FROM supplier WHERE s_name NOT LIKE '%0'")
def k5(spark, d):
    """One table written as two by the prefix of a column."""
    own = table(spark, d, "supplier").select("s_suppkey", "s_name", F.reverse("s_name").alias("turned"))
    paths = new_path(spark, "with"), new_path(spark, "without")
    S.write_by_prefix(own, "turned", "0", *paths)
    parts = [spark.read.parquet(p).select("s_suppkey", "s_name", F.lit(n).alias("part")) for p, n in zip(paths, ("with", "without"), strict=True)]
    return parts[0].unionByName(parts[1])


@query("k6_empty_result", "SELECT count(*) AS n_rows, 3 AS n_columns FROM events WHERE value < -1e300")
def k6(spark, d):
    """A result without rows keeps its columns when it is written and read again."""
    path = new_path(spark, "empty")
    table(spark, d, "events").where("value < -1e300").select("event_id", "event_type", "value").write.parquet(path)
    got = spark.read.parquet(path)
    return got.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(got.columns)))


@query("k7_observed_qa", f"WITH {TOK_SQL} SELECT count(*) AS n_rows, sum((f1 IS NULL)::INT)::BIGINT AS n_missing, count(*) FILTER (fit) AS n_fit, round(min(f1), 6) AS least, round(max(f1), 6) AS most, round(avg(f1), 6) AS mean FROM tok")
def k7(spark, d):
    """What is told of a corpus, taken by the pass that writes it."""
    f1 = F.col("f1")
    rows, got = S.observed(tokens(spark, d), n_rows=F.count(F.lit(1)), n_missing=F.count(F.when(f1.isNull(), 1)), n_fit=F.count(F.when(F.col("fit"), 1)), least=F.min(f1), most=F.max(f1), mean=F.avg(f1))
    rows.write.parquet(new_path(spark, "corpus"))
    said = got()
    return frame(spark, [tuple(said.values())], "n_rows long, n_missing long, n_fit long, least double, most double, mean double")


@query("p4_class_membership", "SELECT event_id, event_type IN ('click', 'view') AS is_member FROM events")
def p4(spark, d):
    return table(spark, d, "events").select("event_id", F.col("event_type").isin("click", "view").alias("is_member"))


@query("o2_single_key", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice")
def o2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice")


__all__ = ["ORACLES", "QUERIES"]

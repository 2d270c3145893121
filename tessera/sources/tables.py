"""Sources and sinks: delimited tables, label tiers, array archives, audio and configuration."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """df; an error if a key comes twice."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{what}: {', '.join(keys)} is not unique")
    return df


def delimited(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """A delimited table with a header and declared types; a row that doesn't fit ends the query."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "FAILFAST").csv(path)


def unit_metadata(spark: SparkSession, path: str) -> DataFrame:
    """unit, status (L1 for fr, else L2) and gender from a table with semicolons."""
    raw = delimited(spark, path, "spk string, L1 string, Gender string", ";")
    status = F.when(F.lower(F.trim("L1")) == "fr", "L1").otherwise("L2")
    return raw.select(F.trim("spk").alias("unit"), status.alias("status"), F.upper(F.lower(F.trim("Gender"))).alias("gender"))


def slots(spark: SparkSession, path: str, repetitions: int = 6) -> DataFrame:
    """slot, word, repetition and symbols from a table with tabs; cells that are no number are left out, the last row of a slot counts."""
    occ = [f"occ.{i}" for i in range(1, repetitions + 1)]
    raw = delimited(spark, path, ", ".join(["Word string", "Ipa string", *[f"`{c}` string" for c in occ]]), "\t")
    rows = raw.withColumn("_at", F.monotonically_increasing_id()).toDF("word", "ipa", *[f"o{i}" for i in range(1, repetitions + 1)], "_at")
    long = rows.unpivot(["word", "ipa", "_at"], [f"o{i}" for i in range(1, repetitions + 1)], "occ", "cell")
    got = long.select("word", "ipa", "_at", F.substring("occ", 2, 9).cast("int").alias("repetition"), F.trim("cell").try_cast("int").alias("slot")).where("slot is not null")
    last = got.withColumn("_r", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("_at"), F.desc("repetition")))).where("_r = 1")
    symbols = F.when(F.trim("ipa") == "N/A", F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split("ipa", ";"), F.trim), lambda x: x != ""))
    return last.select("slot", F.trim("word").alias("word"), "repetition", symbols.alias("symbols"))


# The long text form of interval tiers. A quote within a name or label is doubled; quantifiers keep what they take, as long labels would exhaust the stack.
_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)"'
_HEAD = r'(?U)class = "(\w+)"\s+name = ' + _QUOTED
_INTERVAL = r"xmin = ([\d.eE+-]+)\s+xmax = ([\d.eE+-]+)\s+text = " + _QUOTED


def decoded(content: Column) -> Column:
    """The text of a label file: UTF-16 if its mark says so, else UTF-8 with or without a mark. Other bytes end the query."""
    mark = F.hex(F.substring(content, 1, 3))
    rest = F.when(mark == "EFBBBF", F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    return F.when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.decode(content, "UTF-16")).otherwise(F.decode(rest, "UTF-8"))


def tiers(spark: SparkSession, folder: str, glob: str = "*.TextGrid") -> DataFrame:
    """Intervals of all label files under a folder, empty ones included, files read where the tasks run: path, tier, pos, onset, fin, label.

    A task holds one file at a time, cut into tiers, and one tier's intervals."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content")
    unquoted = lambda x: F.replace(x, F.lit('""'), F.lit('"'))
    found = files.select("path", F.explode(F.split(decoded(F.col("content")), f"(?={_HEAD})")).alias("piece"))
    own = found.where(F.regexp_extract("piece", f"^{_HEAD}", 1) == "IntervalTier")
    body = F.substring(F.col("piece"), F.length(F.regexp_extract("piece", f"^{_HEAD}", 0)) + 1, F.length("piece"))
    cut = own.select("path", unquoted(F.regexp_extract("piece", f"^{_HEAD}", 2)).alias("tier"), F.posexplode(F.regexp_extract_all(body, F.lit(_INTERVAL), F.lit(0))).alias("pos", "interval"))
    part = lambda i: F.regexp_extract("interval", _INTERVAL, i)
    return cut.select("path", "tier", "pos", part(1).cast("double").alias("onset"), part(2).cast("double").alias("fin"), unquoted(part(3)).alias("label"))


def unit_and_slot(path):
    """(unit, slot) columns from the name of a label file; another name ends the query."""
    name = F.element_at(F.split(path, "/"), -1)
    slot = F.regexp_extract(name, r"FRcorp(\d+)\.TextGrid$", 1)
    fine = F.when(slot != "", slot.cast("int")).otherwise(F.raise_error(F.concat(F.lit("unexpected file name "), name)))
    return F.upper(F.split_part(name, F.lit("_"), F.lit(1))), fine


def of_known_units(rows: DataFrame, known: DataFrame, unit: str) -> DataFrame:
    """Rows of units that the metadata know; the names are compared as they are."""
    return rows.join(known.select(unit).distinct(), unit, "left_semi")


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Callable[[], dict[str, object]]]:
    """df with measures that its first action takes on the way, and a function that gives them after it: what is told of a table costs no second pass.

    Spark plans an input that it knows to be empty without the node that measures; all is then null."""
    seen = Observation()

    def got() -> dict[str, object]:
        try:
            return seen.get
        except Py4JJavaError as e:
            if "AssertionError" not in str(e):
                raise
            return dict.fromkeys(metrics)

    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), got


def one_file_each(wanted: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with the one path of its keys; null where there is none, an error where there are several."""
    found = files.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("path").alias("path"))
    checked = found.withColumn("path", F.when(F.col("_n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("several files, first "), F.col("path")))))
    return wanted.join(checked.drop("_n"), keys, "left")


VECTORS = "path string, token_id long, embedding array<float>"


def archives(spark: SparkSession, path: str, key: str = "embeddings", ids: str = "token_ids") -> DataFrame:
    """Rows of array archives: the matrix under key with its ids; both must be there and equally long. Nothing is unpickled."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, c in zip(pdf.path, pdf.content, strict=True):
                with np.load(io.BytesIO(c), allow_pickle=False) as z:
                    if key not in z or ids not in z:
                        raise ValueError(f"{p} lacks {key} or {ids}")
                    x, i = z[key].astype(np.float32), z[ids].astype(np.int64)
                if len(x) != len(i):
                    raise ValueError(f"{p}: {len(x)} rows, {len(i)} ids")
                yield pd.DataFrame({"path": p, "token_id": i, "embedding": list(x)})

    return files.mapInPandas(run, VECTORS)


def archive_bytes(vectors: list, ids: list[int], **scalars) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, embeddings=np.array(vectors, np.float16), token_ids=np.array(ids, np.int64), **scalars)
    return out.getvalue()


@F.pandas_udf(T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))]))
def audio(content: pd.Series) -> pd.DataFrame:
    """16-bit PCM audio as mono floats at 16 kHz: channels averaged, other rates resampled linearly."""
    rows = []
    for raw in content:
        with wave.open(io.BytesIO(raw)) as w:
            rate, channels = w.getframerate(), w.getnchannels()
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, channels).mean(1) / 32768
        if rate != 16000 and len(x):
            n = round(len(x) * 16000 / rate)
            x = np.interp(np.arange(n) * rate / 16000, np.arange(len(x)), x)
        rows.append((16000, x.astype(np.float32)))
    return pd.DataFrame(rows, columns=["rate", "samples"])


def gravity_centre(x: np.ndarray, rate: int) -> float:
    """Spectral centre of gravity, power 2."""
    p = np.abs(np.fft.rfft(x)) ** 2
    return float((np.fft.rfftfreq(len(x), 1 / rate) * p).sum() / p.sum()) if p.sum() > 0 else float("nan")


def write_matrix(long: DataFrame, a: str, b: str, d: str, labels: list[str], path: str) -> None:
    """A labelled square matrix as one delimited file; the matrix has as many rows as there are labels."""
    long.groupBy(a).pivot(b, labels).agg(F.first(d)).orderBy(a).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_by_prefix(df: DataFrame, column: str, prefix: str, with_path: str, without_path: str) -> None:
    """Rows split by a prefix into two tables; both are written with their schema even if empty."""
    has = F.coalesce(F.col(column).startswith(prefix), F.lit(False))
    df.where(has).write.mode("overwrite").parquet(with_path)
    df.where(~has).write.mode("overwrite").parquet(without_path)


def configuration(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def model_layers(config: dict, block: str) -> list[tuple[str, int]]:
    """(model, layer) pairs of a block of the configuration, in order; layers must be lists of numbers."""
    out = []
    for model, spec in config[block].items():
        layers = spec["layers"] if isinstance(spec, dict) else spec
        if not isinstance(layers, list) or not all(isinstance(x, int) for x in layers):
            raise ValueError(f"{block}.{model}: layers must be whole numbers")
        out += [(model, x) for x in layers]
    return out

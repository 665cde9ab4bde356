"""Sources and sinks, each with an explicit schema; nothing is inferred."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions import text as X

log = logging.getLogger(__name__)
NOTES = "array<struct<patientId:string,transcriptions:array<struct<_id:string,text:string>>>>"


@dataclass(frozen=True)
class Options:
    """Settings; ``from_conf`` reads those of a session under ``spark.notemill.``, ``from_yaml`` those of a file."""

    provider: str = "none"
    store_format: str = "mongodb"
    store_uri: str = ""
    store_database: str = "notes"
    dictionary_path: str = "medical_terms.csv"
    threshold: float = 78.0
    window_tokens: int = 6000
    window_requests: int = 28
    window_seconds: int = 60
    use_curated_names: bool = True

    @classmethod
    def from_conf(cls, spark: SparkSession) -> "Options":
        found = {}
        for name, default in vars(cls()).items():
            text = spark.conf.get(f"spark.notemill.{name}", None)
            if text is not None:
                found[name] = text.lower() == "true" if isinstance(default, bool) else type(default)(text)
        return cls(**found)

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> "Options":
        """Settings of a YAML file of any nesting, by their names; a missing or empty one gives the defaults."""
        if not exists(spark, path):
            log.warning("no settings at %s", path)
            return cls()
        import yaml

        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
        found, todo = {}, [yaml.safe_load(text) or {}]
        kinds = {f.name: type(f.default) for f in fields(cls)}
        while todo:
            for key, value in todo.pop().items():
                if isinstance(value, dict):
                    todo.append(value)
                elif key in kinds and value is not None:
                    found[key] = kinds[key](value)
        return cls(**found)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_registry(spark: SparkSession, path: str, role: str) -> DataFrame:
    """role, ord, name of a CSV with the column ``name``; blank names dropped, file order kept; a missing
    file is an empty registry. A registry is one small file, whose lines one task reads in order."""
    schema = T.StructType([T.StructField("name", T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], "role string, ord long, name string")
    rows = spark.read.schema(schema).option("enforceSchema", "false").csv(path, header=True, multiLine=True)
    return rows.select(F.lit(role).alias("role"), F.monotonically_increasing_id().alias("ord"), F.btrim("name").alias("name")).where("name is not null and name <> ''")


def store(spark: SparkSession, options: Options, collection: str) -> DataFrame | None:
    """A collection of the document store, read by the connector that ``store_format`` names; None without an address."""
    if not options.store_uri.strip():
        return None
    return spark.read.format(options.store_format).option("connection.uri", options.store_uri).option("database", options.store_database).option("collection", collection).load()


def registry_from(read: Callable[[], DataFrame | None], fallback: DataFrame, role: str, name_col: str = "name", ord_col: str | None = None) -> DataFrame:
    """A registry from what ``read`` gives (a document store's rows), or the fallback where it gives none or fails. Names
    are in the order of ``ord_col``, else of the alphabet, so that partitioning doesn't matter."""
    try:
        documents = read()
        good = documents.where(F.col(name_col).isNotNull() & (F.btrim(name_col) != "")) if documents is not None else None
        if good is None or good.isEmpty():
            return fallback
    except Exception as error:  # whatever a connector raises: the file is the way out
        log.warning("registry of %s: %s", role, error)
        return fallback
    order = [F.col(ord_col)] if ord_col else []
    return good.orderBy(*order, F.btrim(name_col)).select(F.lit(role).alias("role"), F.monotonically_increasing_id().alias("ord"), F.btrim(name_col).alias("name"))


def parse_id(value: Column) -> Column:
    """An id of 24 hexadecimal digits in lower case, as stores print object ids; any other as it is."""
    return F.when(value.rlike(r"\A[0-9A-Fa-f]{24}\z"), F.lower(value)).otherwise(value)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """ord, term, meaning, variants of a dictionary CSV; a missing file is an empty dictionary."""
    fields = ["Term", "Actual Meaning", "Voice Misinterpretations"]
    empty = "ord long, term string, meaning string, variants array<string>"
    if not exists(spark, path):
        return spark.createDataFrame([], empty)
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    text = lambda c: F.btrim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) if c in rows.columns else F.lit("")
    return rows.select(F.monotonically_increasing_id().alias("ord"), text(fields[0]).alias("term"), text(fields[1]).alias("meaning"), X.json_list(text(fields[2])).alias("variants"))


def note_text(documents: DataFrame, transcription_id: str, ord_col: str | None = None) -> DataFrame:
    """The text of the nested transcription with an id, of the first document that has it: one row, or none."""
    order = F.col(ord_col) if ord_col else F.lit(0)
    flat = documents.select(order.alias("ord"), F.posexplode("patientsNotes").alias("i", "n")).select("ord", "i", F.posexplode("n.transcriptions").alias("j", "t"))
    own = flat.where(parse_id(F.col("t._id")) == parse_id(F.lit(transcription_id)))
    return own.select("ord", "i", "j", F.col("t.text").alias("text")).orderBy("ord", "i", "j", "text").limit(1).select("text")


def patient_text(documents: DataFrame, ord_col: str = "ord") -> DataFrame:
    """patientId and ``text`` of each patient: the non-empty texts of the first document that has the
    patient, in order, joined by a blank line."""
    flat = documents.select(ord_col, F.posexplode("patientsNotes").alias("i", "n"))
    flat = flat.select(ord_col, "i", "n.patientId", F.filter(F.transform("n.transcriptions", lambda t: t["text"]), lambda t: F.coalesce(t, F.lit("")) != "").alias("texts"))
    first = flat.groupBy("patientId").agg(F.min(ord_col).alias(ord_col))
    own = flat.join(first, ["patientId", ord_col])
    return own.groupBy("patientId").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "texts"))), lambda x: x["texts"])), "\n\n").alias("text"))


def resolve_text(requests: DataFrame, looked_up: DataFrame, key: str) -> DataFrame:
    """``requests`` with ``text``: what they bring, else what the store has, and ``status``."""
    joined = requests.join(looked_up.select(key, F.col("text").alias("_found")), key, "left")
    text = F.coalesce(F.when(F.btrim("txt") != "", F.col("txt")), F.col("_found"))
    return joined.withColumns({"text": text, "status": F.when(text.isNull(), "no text").otherwise("ok")}).drop("_found")


def write_maps(maps: DataFrame, path: str) -> None:
    """Token maps, one partition folder a session; sessions that are written again replace their own."""
    maps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").json(path)


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    schema = "token string, canonical string, session_id string"
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def lexicon_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The static word lists as tables."""
    column = lambda xs: spark.createDataFrame(list(enumerate(xs)), "ord int, name string")
    return {
        "first_names": column(L.first_names()),
        "surnames": column(L.SURNAMES),
        "curated_names": column(L.curated_names()),
        "phonetic_variants": spark.createDataFrame(list(L.phonetic_variants().items()), "variant string, name string"),
        "accent_rules": spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(L.accent_rules())], "ord int, pattern string, replacement string"),
    }

"""Readers of conjunction messages: KVN documents, JSON and NDJSON, normalized to one row per message."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysieve.operators.messages import covariance_determinant, days_between, log_probability, mahalanobis, number, with_unit

_RECORD = "map<string,string>"


def kvn_documents(text: str) -> list[dict[str, str]]:
    """The documents of a KVN text, as fields; keys of object sections carry SAT1_ or SAT2_, units come as KEY_UNIT."""
    documents: list[dict[str, str]] = []
    section = ""
    for n, line in enumerate(map(str.strip, text.splitlines()), 1):
        if not line or line.startswith(("COMMENT", "#")):
            continue
        key, equals, value = (part.strip() for part in line.partition("="))
        key = key.upper()
        if not (equals and key and value):
            raise ValueError(f"line {n} is not KEY = VALUE")
        if key == "CCSDS_CDM_VERS" or not documents:
            documents.append({})
            section = ""
        if key == "OBJECT":
            which = value.upper().replace("_", "").removeprefix("OBJECT").removeprefix("SAT")
            if which not in ("1", "2"):
                raise ValueError(f"line {n} names an unknown object")
            section = f"SAT{which}_"
            continue
        unit = ""
        if value.endswith("]") and (at := value.rfind("[")) > 0 and value[at + 1 : -1].strip():
            value, unit = value[:at].strip(), value[at + 1 : -1].strip()
        if section + key in documents[-1]:
            raise ValueError(f"line {n} repeats {section + key}")
        documents[-1][section + key] = value
        if unit:
            documents[-1][f"{section}{key}_UNIT"] = unit
    if not documents or not all("CCSDS_CDM_VERS" in d for d in documents):
        raise ValueError("no document with a version line")
    return documents


#: Begins a document on a line of its own.
_VERSION = "CCSDS_CDM_VERS"


def _bare(text: str) -> bool:
    return all(not line or line.startswith(("COMMENT", "#")) for line in map(str.strip, text.splitlines()))


def parse_kvn(texts: DataFrame, column: str = "value", pieces: bool = False) -> DataFrame:
    """record (map) of every document in a column of KVN texts. `pieces` are what lies between the version keys of a file: they get their key
    back, and what comes before the first one may hold comments only."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [_VERSION + t if pieces and t.lstrip().startswith("=") else t for t in batch["t"] if t and not (pieces and _bare(t))]
            yield pd.DataFrame({"record": [d for t in texts for d in kvn_documents(t)]})

    return texts.select(F.col(column).alias("t")).mapInPandas(parse, f"record {_RECORD}")


def read_kvn(spark: SparkSession, path: str) -> DataFrame:
    """record (map) of every document of the files; split at version lines, so files of any size are read in parallel, document by document."""
    return parse_kvn(spark.read.text(path, lineSep="\n" + _VERSION), pieces=True)


def _clean(record: Column) -> Column:
    return F.transform_keys(record, lambda k, _: F.upper(F.btrim(k)))


def parse_ndjson(lines: DataFrame, column: str = "value") -> DataFrame:
    """record (map) of each line that is not blank."""
    return lines.filter(F.btrim(column) != "").select(_clean(F.from_json(column, _RECORD)).alias("record"))


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """record (map) of each line; splittable, so files of any size are read in parallel."""
    return parse_ndjson(spark.read.text(path))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """record (map) of files that hold one object or an array of them."""
    whole = spark.read.text(path, wholetext=True).select(F.btrim("value").alias("value"))
    many = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{_RECORD}>")).otherwise(F.array(F.from_json("value", _RECORD)))
    return whole.select(F.explode(many).alias("r")).select(_clean(F.col("r")).alias("record"))


def adapt(records: DataFrame) -> DataFrame:
    """Normalized messages from records. Creation or approach that cannot be read, and creation after approach, are errors; so
    are unknown units. Other values that cannot be read are null."""

    def get(key: str) -> Column:
        return F.try_element_at("record", F.lit(key))

    def first_of(*keys: str) -> Column:
        out = F.lit(None).cast("string")
        for key in reversed(keys):
            out = F.when(F.map_contains_key("record", key), get(key)).otherwise(out)
        return out

    def triangle(side: str) -> tuple[Column, ...]:
        return tuple(number(get(f"SAT{side}_{k}")) for k in ("CR_R", "CT_R", "CT_T", "CN_R", "CN_T", "CN_N"))

    def designator(side: str) -> Column:
        found = [F.nullif(F.btrim(get(f"SAT{side}_{k}")), F.lit("")) for k in ("OBJECT_DESIGNATOR", "NORAD_CAT_ID", "OBJECT_NAME")]
        return F.coalesce(*found)

    def time(text: Column, name: str) -> Column:
        return F.coalesce(F.try_to_timestamp(text), F.raise_error(F.lit(f"{name} cannot be read")).cast("timestamp"))

    risk = log_probability(number(get("COLLISION_PROBABILITY")))
    a, b = triangle("1"), triangle("2")
    one, two = designator("1"), designator("2")
    position = tuple(number(get(f"RELATIVE_POSITION_{k}")) for k in "RTN")
    rows = records.select(
        F.concat_ws("|", F.least(one, two), F.greatest(one, two)).alias("event_pair"),
        F.coalesce(F.nullif(F.btrim(first_of("MESSAGE_ID", "CDM_ID")), F.lit("")), F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("record")))), 256)).alias("source_message_id"),
        time(first_of("CREATION_DATE", "INSERT_EPOCH"), "creation").alias("creation_date"), time(get("TCA"), "closest approach").alias("tca"), risk.alias("risk"),
        F.coalesce(log_probability(number(first_of("COLLISION_MAX_PROBABILITY", "COLLISION_MAX_PC"))), risk).alias("max_risk_estimate"), number(get("COLLISION_MAX_PC_SCALE_FACTOR")).alias("max_risk_scaling"),
        with_unit(get("MISS_DISTANCE"), get("MISS_DISTANCE_UNIT"), ("m", "meter", "metre")).alias("miss_distance"), with_unit(get("RELATIVE_SPEED"), get("RELATIVE_SPEED_UNIT"), ("m/s", "m/sec", "m/s**1")).alias("relative_speed"),
        mahalanobis(position, a, b, number(get("MAHALANOBIS_DISTANCE"))).alias("mahalanobis_distance"), covariance_determinant(*a).alias("t_position_covariance_det"), covariance_determinant(*b).alias("c_position_covariance_det"),
        *(number(get(f"SAT{side}_{k}")).alias(f"{p}_{k.lower()}") for side, p in (("1", "t"), ("2", "c")) for k in ("OBS_AVAILABLE", "OBS_USED", "WEIGHTED_RMS")),
        one.alias("mission_id"), F.coalesce(get("SAT2_OBJECT_TYPE"), F.lit("__MISSING__")).alias("c_object_type"),
    )
    days = days_between(F.col("creation_date"), F.col("tca"))
    return rows.withColumn("time_to_tca", F.when(days >= 0, days).otherwise(F.raise_error(F.lit("a message was created after its closest approach")).cast("double")))

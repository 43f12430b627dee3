"""The audit: a profile, findings and a verdict as one canonical document, published as a folder of Spark tables."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer import core
from assayer.operators import profile as profiles
from assayer.operators import quality, target as targets
from assayer.operators.profile import quoted


def canonical(value: Any, path: str = "$") -> Any:
    """Plain values: NaN as null; infinities and unknown types refused by their path."""
    if isinstance(value, float):
        if math.isinf(value):
            raise core.PublicationError(f"{path} is infinite")
        return None if math.isnan(value) else value
    if isinstance(value, dict):
        return {str(k): canonical(v, f"{path}.{k}") for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [canonical(v, f"{path}[{i}]") for i, v in enumerate(value)]
    if value is None or isinstance(value, (bool, int, str)):
        return value
    raise core.PublicationError(f"{path} is a {type(value).__name__}")


def canonical_json(value: Any) -> str:
    return json.dumps(canonical(value), sort_keys=True, ensure_ascii=False, indent=2, allow_nan=False)


def fingerprint(df: DataFrame) -> DataFrame:
    """Content digest that no partitioning or order changes: rows, and sum and xor of row hashes."""
    row = F.xxhash64(*[F.coalesce(quoted(c).cast("string"), F.lit("\x00null")) for c in df.columns])
    return core.normalize(df).agg(
        F.count("*").alias("rows"), F.bit_xor(row).alias("xor"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("sum")
    )


def redacted(profile: DataFrame) -> DataFrame:
    """The profile with each dominant value as the SHA-256 of its byte length, a colon and its bytes; measurements stay."""
    value = F.col("dominant").cast("string")
    return profile.withColumn("dominant", F.sha2(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), 256))


def audit(df: DataFrame, order: str, target: str | None = None, config: core.Config = core.Config()) -> dict[str, Any]:
    """Profile, findings, target and verdict; what reaches the driver is a row a column or finding.

    Values of the table are not written out: a dominant value is its digest.
    """
    profile = redacted(profiles.profile(df, order, config)).persist()
    findings = quality.inspect(df, order, target, config).orderBy("code", "column").persist()
    document: dict[str, Any] = {
        "schema_version": "1",
        "fingerprint": fingerprint(df).first().asDict(),
        "profile": [r.asDict() for r in profile.orderBy("column").collect()],
        "findings": [r.asDict() for r in findings.collect()],
        "verdict": quality.verdict(findings),
    }
    if target is not None:
        try:
            document["target"] = vars(targets.detect(df, target, config=config))
        except core.AssayError as refused:
            document["target"] = {"refused": str(refused)}
    for row in (*document["profile"], *document["findings"]):
        for k, v in row.items():
            if isinstance(v, float) and math.isinf(v):
                row[k] = "infinite"
    document["digest"] = hashlib.sha256(canonical_json(document).encode()).hexdigest()
    profile.unpersist()
    findings.unpersist()
    return document


def publish(spark: SparkSession, document: dict[str, Any], folder: str) -> str:
    """Write the document under its digest with Spark's own committed writer; a folder of that name is final."""
    place = f"{folder.rstrip('/')}/{document['digest']}"
    spark.createDataFrame([(canonical_json(document),)], "document string").coalesce(1).write.mode("error").text(place)
    return place


def read(spark: SparkSession, place: str) -> dict[str, Any]:
    """Read a published document back and verify its digest."""
    document = json.loads("\n".join(r[0] for r in spark.read.text(place, wholetext=True).collect()))
    claimed = document.pop("digest")
    if hashlib.sha256(canonical_json(document).encode()).hexdigest() != claimed:
        raise core.PublicationError("the digest does not match")
    return document | {"digest": claimed}


def differences(a: dict[str, Any], b: dict[str, Any]) -> list[str]:
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))

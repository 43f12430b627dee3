"""Settings, refusals, column kinds and the normal form that every measurement starts from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AssayError(Exception):
    """Root of the typed refusals."""


class ConfigurationError(AssayError): ...


class SchemaError(AssayError): ...


class EmptyDataError(AssayError): ...


class NonNumericDataError(AssayError): ...


class NonFiniteValueError(AssayError): ...


class DomainError(AssayError):
    """A statistic is not defined for these values."""


class IngestionError(AssayError): ...


class MalformedInputError(IngestionError):
    """Text that is no table; ``line`` is where, counted from 1, or the number of a record."""

    def __init__(self, message: str, line: int | None = None) -> None:
        super().__init__(message)
        self.line = line


class NestedValueError(MalformedInputError, SchemaError): ...


class EncodingError(IngestionError): ...


class DuplicateHeadersError(IngestionError, SchemaError): ...


class LimitExceededError(IngestionError):
    def __init__(self, limit: str, configured: int, observed: int) -> None:
        super().__init__(f"{limit} is {configured}, found {observed}")
        self.limit, self.configured, self.observed = limit, configured, observed


class MissingDependencyError(AssayError): ...


class AmbiguousTaskError(AssayError): ...


class UnsupportedTaskError(AssayError): ...


class IncompatibleModelError(AssayError): ...


class PreprocessingError(AssayError): ...


class PublicationError(AssayError): ...


@dataclass(frozen=True)
class Config:
    """Thresholds of the checks; defaults are the documented ones."""

    random_state: int = 42
    validation_size: float = 0.2
    missing_warning: float = 0.2
    near_constant: float = 0.98
    high_cardinality: int = 50
    id_uniqueness: float = 0.95
    iqr_multiplier: float = 1.5
    leakage_correlation: float = 0.98
    vif: float = 10.0
    imbalance: float = 0.2
    numeric_text_ratio: float = 0.75
    max_classes: int = 20
    class_unique_ratio: float = 0.05
    cadence: str | None = None

    def __post_init__(self) -> None:
        for name in ("validation_size", "missing_warning", "near_constant", "id_uniqueness", "imbalance", "numeric_text_ratio"):
            if not 0 < getattr(self, name) <= 1:
                raise ConfigurationError(f"{name} must lie in (0, 1]")
        if self.high_cardinality < 1 or self.iqr_multiplier <= 0 or self.vif <= 1:
            raise ConfigurationError("thresholds must be positive, vif above 1")


BOOLEAN, NUMERIC, CATEGORICAL, DATETIME, OTHER = "boolean", "numeric", "categorical", "datetime", "other"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    return OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    """Kind of each column; nested columns and repeated names are refused."""
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) < len(lowered):
        raise SchemaError("column names repeat")
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise SchemaError(f"column {f.name} is nested")
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [c for c, k in kinds(df).items() if k in wanted]


def normalize(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so one value means missing, and -0.0 becomes 0.0."""
    floats = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    plain = lambda c: (F.nanvl(named(c), F.lit(None)) + F.lit(0.0).cast(floats[c])).alias(c)
    return df.select(*[plain(c) if c in floats else named(c) for c in df.columns])


def finite(c: Column) -> Column:
    """The value as double where it is a finite number, else NULL."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

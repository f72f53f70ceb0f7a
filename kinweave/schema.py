"""Record schemas, header aliases and the linkage job description."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


FEBRL = T.StructType(
    _strings(
        "rec_id",
        "given_name",
        "surname",
        "street_number",
        "address_1",
        "address_2",
        "suburb",
        "postcode",
        "state",
        "date_of_birth",
        "soc_sec_id",
    )
)

USA = T.StructType(
    _strings("given_name", "surname", "birthdate", "address", "county", "city", "state", "zip")
    + [T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())]
)

ADDRESS = T.StructType(_strings("address", "city", "state", "zip"))

PROVIDER = T.StructType(_strings("Provider_Name"))

PRESETS = {"febrl": FEBRL, "usa": USA, "address": ADDRESS, "provider": PROVIDER}

# fixed values: the columns each preset encrypts
ENCRYPTED = {
    "febrl": [
        "rec_id",
        "given_name",
        "surname",
        "street_number",
        "address_1",
        "address_2",
        "suburb",
        "postcode",
        "state",
        "date_of_birth",
        "soc_sec_id",
    ],
    "usa": [
        "given_name",
        "surname",
        "birthdate",
        "address",
        "county",
        "city",
        "state",
        "zip",
        "latitude",
        "longitude",
    ],
}

LABEL_COLUMN = "cluster"


def require_columns(df: DataFrame, names: list[str], exactly: bool = False) -> DataFrame:
    """Raises unless ``df`` has the named columns (and, with ``exactly``, no others)."""
    missing = [n for n in names if n not in df.columns]
    extra = [c for c in df.columns if c not in names] if exactly else []
    if missing or extra:
        raise ValueError(f"missing columns {missing}, unexpected columns {extra}")
    return df


def has_labels(df: DataFrame) -> bool:
    return LABEL_COLUMN in df.columns


@dataclass(frozen=True)
class LinkJob:
    """What to do, on which tables, with which preset."""

    dataset: str = "febrl"
    operation: str = "dedupe_only"
    source: str = "csv"
    paths: tuple[str, ...] = ()
    geocoding: bool = False
    cluster_threshold: float = 0.70
    profile: bool = False
    jdbc: dict = field(default_factory=dict)
    json_orient: str = "lines"
    multiline: bool | None = None

    def __post_init__(self):
        if self.dataset not in ("febrl", "usa"):
            raise ValueError(f"unknown dataset {self.dataset}")
        if self.operation not in ("dedupe_only", "link_only"):
            raise ValueError(f"unknown operation {self.operation}")
        wanted = 1 if self.operation == "dedupe_only" else 2
        if len(self.paths) != wanted:
            raise ValueError(f"{self.operation} takes {wanted} tables, got {len(self.paths)}")

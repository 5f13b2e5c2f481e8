"""A mixed-type table: a DataFrame with its key, numeric and categorical columns, and the numbers that distances need."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Fixed list: names of columns that are taken for the key, in order.
ID_NAMES = ("HHID", "Id", "ID", "id", "household_id")


def split_types(df: DataFrame, drop: tuple[str, ...] = (), categorical: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns by type; ``categorical`` overrides. Dates and nested types belong to neither."""
    fields = [f for f in df.schema.fields if f.name not in drop]
    num = [f.name for f in fields if isinstance(f.dataType, NUMERIC) and f.name not in categorical]
    cat = [f.name for f in fields if isinstance(f.dataType, T.StringType | T.BooleanType) or f.name in categorical]
    return num, cat


def infer_id(df: DataFrame) -> str | None:
    return next((c for c in ID_NAMES if c in df.columns), None)


def hash_order(seed: int, *keys: str) -> Column:
    """The order by which rows are sampled: the same in any engine, and for any partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))


def spread(df: DataFrame, key: str, n: int, rows: int = 1 << 18) -> DataFrame:
    """The ``n`` rows in tasks of about ``rows`` rows, and no fewer tasks than run at once, however few splits a file has; small
    tables as they lie."""
    return df if n <= 20_000 else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / rows)), key)


@dataclass
class MixedFrame:
    df: DataFrame
    key: str
    num: list[str]
    cat: list[str]
    label: str | None = None

    def select(self, columns: list[str]) -> MixedFrame:
        out = replace(self, num=[c for c in self.num if c in columns], cat=[c for c in self.cat if c in columns])
        if "stats" in self.__dict__:
            out.__dict__["stats"] = self.stats  # of the same rows: nothing is counted anew
        return out

    @property
    def clean(self) -> DataFrame:
        """Key, label, doubles and strings only, so that the scan reads no other column. A null number counts as 0, a null
        category as the value "nan"; impute before where that is not meant."""
        cols = [F.col(self.key), *([F.col(self.label).alias("label")] if self.label else [])]
        return self.df.select(*cols, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.num], *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in self.cat])

    @cached_property
    def n(self) -> int:
        return self.stats["n"]

    @cached_property
    def fits(self) -> dict:
        """Clusterings that were fitted to these rows and columns, by their parameters; another selection begins anew."""
        return {}

    @cached_property
    def stats(self) -> dict:
        """Row count, and per numeric column least, greatest and 1 / range; one pass, one row."""
        aggs = [F.count(F.lit(1)).alias("n"), *[x for c in self.num for x in (F.min(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"lo_{c}"), F.max(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"hi_{c}"))]]
        row = self.df.agg(*aggs).first()
        out = {"n": row["n"]}
        for c in self.num:
            lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
            out[c] = (lo, hi, 1.0 / max((hi - lo) if lo is not None else 0.0, 1e-9))
        return out

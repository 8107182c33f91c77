"""Sums by month and dimension, kept beside the builds and refreshed for changed months only.

A metric over whole months needs no fact: it adds up sums that were made once. Each table of
sums holds additive columns under the keys its metrics group or filter by, so any period of
whole months, any region and any of the groupings is a sum of its rows.

The sums of a month depend on the month's fact rows alone. Those are digested (row count and a
sum of row hashes over the columns that matter), and a build whose digest of a month equals that
of an earlier build points at the sums already there. One job per table writes all months that
are new. Folders are never overwritten, so readers of an older build keep theirs; which folder
holds a month is part of the build. A refresh that dies leaves a folder that nothing points at.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce
from typing import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D
from ..operators import service, spread
from ..operators.periods import Period
from ..operators.scope import fulfilled
from ..session import CODEC, folder_exists, shuffles_removed
from .star import StoredStar

FOLDER, MANIFEST = "monthly", "_monthly"
AT_ONCE = 4
# New months are summed in so many parts at most, of so many fact rows at least: only the shuffles of a part lie on disk.
MOST_PARTS, PART_ROWS = 8, 400_000
PLACE = ("outlet_id", "region_id", "route_id", "warehouse_id")


@dataclass(frozen=True)
class Sums:
    """One table of sums: the facts it is made of, as (rows, columns that matter), and how."""

    day: str
    keys: tuple[str, ...]
    facts: Callable[[StoredStar], list[DataFrame]]
    rows: Callable[[StoredStar, Column], DataFrame]  # the star, and which months of lines
    sums: tuple[Column, ...]
    apart: bool = True  # a month's sums hang on its own rows only, whichever other months are made along with it

    @property
    def month(self) -> str:
        return f"{self.day}_month"

    def of(self, star: StoredStar, months: list[str] | None = None) -> DataFrame:
        """The sums, made from facts; of some months only, if given (the empty name is that of rows without a day)."""
        only = F.lit(True) if months is None else F.coalesce(F.col(self.month), F.lit("")).isin(months)
        return self.rows(star, only).where(only).groupBy(*self.keys, self.month).agg(*self.sums)


def _sum(*names: str) -> tuple[Column, ...]:
    return tuple(F.sum(n).alias(n) for n in names)


def _lines(star, *columns: str) -> DataFrame:
    return star.order_lines.select("order_date_month", "order_status", *columns)


# Built when first needed, as columns need a session.
def tables() -> dict[str, Sums]:
    units = ("ordered_eaches", "delivered_eaches", "delivered_cases")
    return {
        "lines_by_place": Sums(
            "order_date", PLACE, lambda s: [_lines(s, *PLACE, *units)],
            lambda s, only: s.order_lines.where(fulfilled()), _sum(*units),
        ),
        "lines_by_product": Sums(
            "order_date", ("region_id", "product_id"), lambda s: [_lines(s, "region_id", "product_id", "line_value_inr")],
            lambda s, only: s.order_lines.where(fulfilled()), _sum("line_value_inr"),
        ),
        "freight": Sums(
            "invoice_date", ("warehouse_id", "route_region_id", "carrier_id", "carrier_name"),
            lambda s: [s.freight.select("invoice_date_month", "warehouse_id", "route_region_id", "carrier_id", "carrier_name", "amount_inr")],
            lambda s, only: s.freight.withColumns({"n": F.lit(1), "n_amount": F.col("amount_inr").isNotNull().cast("int")}),
            _sum("amount_inr", "n", "n_amount"),
        ),
        "returns": Sums(
            "return_date", ("region_id", "category", "return_reason_code"),
            lambda s: [s.returns.select("return_date_month", "region_id", "category", "return_reason_code", "credit_note_value_inr")],
            lambda s, only: s.returns.withColumn("n", F.lit(1)), _sum("credit_note_value_inr", "n"),
        ),
        # Deliveries count in the month of their order: a change of either changes the order's month.
        "otif_by_place": Sums(
            "order_date", PLACE,
            lambda s: [_lines(s, "order_id", "ordered_eaches", "delivered_eaches"), _deliveries_by_order_month(s)],
            lambda s, only: _monthed(service.otif_by_order(s, only=fulfilled() & only), "order_date"), _sum(*service.OTIF_SUMS),
            apart=False,  # an order whose lines lie in two months, as of a repeated order id, counts in the first of those made
        ),
        "delay_sketch": _sketches("delay", lambda s: [s.deliveries.select("dispatch_datetime_month", "region_id", "delay_minutes")]),
        "fulfilment_sketch": _sketches("fulfilment", lambda s: [_lines(s, "order_id", "region_id", "ordered_eaches", "delivered_eaches")]),
    }


def _sketches(measure: str, facts: Callable[[StoredStar], list[DataFrame]]) -> Sums:
    """Mergeable sketches of a measure; they add up as sums do."""
    day = spread.DAY_OF[measure]
    return Sums(
        day, ("region_id",), facts, lambda s, only: _monthed(spread.values(s, measure, only=only), day), spread.sketch_sums()
    )


def _monthed(df: DataFrame, day: str) -> DataFrame:
    return df.withColumn(f"{day}_month", D.month_key(F.col(day)))


def _deliveries_by_order_month(star) -> DataFrame:
    """Deliveries under the month of their order."""
    month = star.order_lines.groupBy("order_id").agg(F.min("order_date_month").alias("order_date_month"))
    return star.deliveries.select("order_id", *PLACE, "delay_minutes").join(month, "order_id")


def digests(parts: list[DataFrame], month: str) -> DataFrame:
    """``month``, ``digest``: row counts and sums of row hashes of each part; equal for equal rows in any order."""
    out = None
    for i, df in enumerate(parts):
        row = F.xxhash64(F.lit(i), *[F.col(c).cast("string") for c in sorted(df.columns) if c != month])
        sums = df.groupBy(F.col(month).alias("month")).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).alias("d"))
        sums = sums.select(F.coalesce("month", F.lit("")).alias("month"), F.lit(i).alias("part"), "d")
        out = sums if out is None else out.unionByName(sums)
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("part", "d"))).getField("d"), "/")  # one entry per part
    return out.groupBy("month").agg(joined.alias("digest"))


def parts_of(rows: dict[str, int]) -> list[list[str]]:
    """Months, given with their fact rows, dealt into parts of about equal rows."""
    parts = [(0, []) for _ in range(max(1, min(MOST_PARTS, sum(rows.values()) // PART_ROWS, len(rows))))]
    for month, n in sorted(rows.items(), key=lambda item: (-item[1], item[0])):
        least = min(range(len(parts)), key=lambda i: parts[i][0])
        parts[least] = (parts[least][0] + n, [*parts[least][1], month])
    return [sorted(months) for _, months in parts if months]


def _digested_rows(digest: str) -> int:
    return sum(int(part.partition(":")[0]) for part in digest.split("/"))


MANIFEST_COLUMNS = "table_name string, month string, digest string, folder string"


def _earlier(star: StoredStar, out: str) -> DataFrame:
    """The manifest rows of all earlier refreshes."""
    path = f"{out}/manifests"
    spark = star.spark
    return spark.read.schema(MANIFEST_COLUMNS).parquet(f"{path}/*") if folder_exists(spark, path) else spark.createDataFrame([], MANIFEST_COLUMNS)


def refresh(star: StoredStar, out: str) -> DataFrame:
    """Make the sums of a build's months that no earlier build had, and file where each month's sums lie.

    Returns ``table_name``, ``month``, ``digest``, ``folder``: a row per table and month.
    """
    with shuffles_removed(star.spark):
        return _refresh(star, out)


def _refresh(star: StoredStar, out: str) -> DataFrame:
    spark, run = star.spark, uuid4().hex
    known = _earlier(star, out).groupBy("table_name", "month", "digest").agg(F.min("folder").alias("known"))

    def one(name: str, t: Sums) -> list[tuple]:
        earlier = known.where(F.col("table_name") == name).drop("table_name")
        months = digests(t.facts(star), t.month).join(earlier, ["month", "digest"], "left").collect()  # one row per month
        new = {r["month"]: _digested_rows(r["digest"]) for r in months if r["known"] is None}
        folder = f"{out}/{name}/{run}"
        for part in parts_of(new) if t.apart else [[*new]] if new else []:
            made = t.of(star, part).hint("rebalance", F.col(t.month))
            made.write.mode("append").partitionBy(t.month).parquet(folder, compression=CODEC)
        return [(name, r["month"], r["digest"], r["known"] or folder) for r in months]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = [r for found in pool.map(lambda item: one(*item), tables().items()) for r in found]
    manifest = spark.createDataFrame(rows, MANIFEST_COLUMNS).coalesce(1)  # one row per table and month
    manifest.write.parquet(f"{out}/manifests/{run}")
    manifest.write.parquet(f"{star.path}/{MANIFEST}")
    return spark.read.schema(MANIFEST_COLUMNS).parquet(f"{star.path}/{MANIFEST}")


class MonthlyStar(StoredStar):
    """A stored star whose metrics read sums where a period is one of whole months, and facts where it is not."""

    @cached_property
    def _folders(self) -> dict[str, dict[str, list[str]]]:
        """Per table: folder of sums -> its months that belong to this build."""
        out: dict[str, dict[str, list[str]]] = {}
        for r in self.spark.read.parquet(f"{self.path}/{MANIFEST}").collect():  # one row per table and month
            out.setdefault(r["table_name"], {}).setdefault(r["folder"], []).append(r["month"])
        return out

    def sums(self, name: str, period: Period) -> DataFrame:
        """Sums of the months of ``period``; the first of its month stands for the day."""
        t = tables()[name]
        made = t.of(self)
        parts = []
        for folder, months in self._folders.get(name, {}).items():
            df = self.spark.read.schema(made.schema).parquet(folder).select(*made.columns)
            parts.append(df.where(F.coalesce(F.col(t.month), F.lit("")).isin(months)))
        kept = reduce(DataFrame.unionByName, parts) if parts else made
        return period.of(kept.withColumn(t.day, F.to_date(F.concat(t.month, F.lit("-01")))), t.day)

    def fulfilled_lines(self, period: Period, grain: str) -> DataFrame:
        if not period.whole_months:
            return super().fulfilled_lines(period, grain)
        return self.sums(f"lines_by_{grain}", period)

    def freight_rows(self, period: Period) -> DataFrame:
        return self.sums("freight", period) if period.whole_months else super().freight_rows(period)

    def return_rows(self, period: Period) -> DataFrame:
        return self.sums("returns", period) if period.whole_months else super().return_rows(period)

    def otif_rows(self, period: Period, on_time_threshold_minutes: int) -> DataFrame | None:
        if not period.whole_months or on_time_threshold_minutes != 0:
            return None
        return self.sums("otif_by_place", period)

    def sketch_rows(self, measure: str, period: Period) -> DataFrame | None:
        return self.sums(f"{measure}_sketch", period) if period.whole_months else None


def of(star: StoredStar) -> MonthlyStar:
    return MonthlyStar(star.spark, star.path)



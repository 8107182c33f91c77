"""Reading and normalising what upstream systems land: operational tables, partner feeds, weather.

A bad record either stops the read (``read_table``) or goes into quarantine (``read_checked``):
good records are kept, rejected ones are named by file and reason, and the gate of the build
warns where a feed lost more than a stated share.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import dates as D
from ..plans.star import Landed


def read_table(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A landed table under its declared schema; nothing is inferred.

    CSV and JSON are parsed with the schema, so bad records fail. Parquet and ORC carry
    types of their own and are cast to it.
    """
    reader = spark.read.options(**options)
    if fmt in ("csv", "json"):
        header = {"header": True} if fmt == "csv" else {}
        return reader.options(**header).option("mode", "FAILFAST").schema(schema).format(fmt).load(path)
    df = reader.format(fmt).load(path)
    missing = F.lit(None)
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else missing).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


REJECTED = schemas.table_schema("source STRING, file STRING, reason STRING, record STRING")
_RECORD = "_corrupt_record"


@dataclass(frozen=True)
class Checked:
    """Records that fit the schema, and those that don't: ``source``, ``file``, ``reason``, ``record``."""

    rows: DataFrame
    rejected: DataFrame


def _reason(schema, fmt: str, options: dict) -> Column:
    """Fields whose text does not fit their type, or what else is wrong with a record."""
    texts = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    record = F.col(_RECORD)
    read = F.from_csv(record, texts, options) if fmt == "csv" else F.from_json(record, texts, options)
    # A field was read if it has a value as a text; it was refused if it has none as its own type.
    bad = [F.when(read[f.name].isNotNull() & F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in schema.fields]
    names = F.array_join(F.array_compact(F.array(*bad)), ", ")
    return F.when(names != "", F.concat(F.lit("bad value: "), names)).otherwise("not a whole record")


def read_checked(spark: SparkSession, path: str, schema, source: str, fmt: str = "csv", **options) -> Checked:
    """A landed CSV or JSON table, its bad records apart. Nothing is inferred, and one scan serves either side.

    A record is bad if a field does not fit its type, or if it is cut short, has too many fields or is no JSON.
    A missing folder, or one without files, gives empty frames.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("records are checked in csv and json only; other formats carry types of their own")
    if not _has_data(spark, path):
        return Checked(schemas.empty(spark, schema), schemas.empty(spark, REJECTED))
    options = ({"header": True} if fmt == "csv" else {}) | options
    wide = schemas.T.StructType([*schema.fields, schemas.T.StructField(_RECORD, schemas.T.StringType())])
    reader = spark.read.options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD)
    read = reader.schema(wide).format(fmt).load(path)
    plain = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    # A parser that is asked for few columns checks only those: every column takes part in either side's condition.
    parsed = F.xxhash64(*[F.col(f"`{f.name}`") for f in schema.fields]) >= F.lit(-(2**63))
    rejected = read.where(F.col(_RECORD).isNotNull() & parsed).select(
        F.lit(source).alias("source"), F.input_file_name().alias("file"), _reason(schema, fmt, plain).alias("reason"),
        F.col(_RECORD).alias("record"),
    )
    good = read.where(F.col(_RECORD).isNull() & parsed)
    return Checked(good.select(*[F.col(f"`{f.name}`") for f in schema.fields]), rejected)


def quarantined(checked: Checked, folder: str) -> Checked:
    """Write the rejected records below ``folder``, a new part of it each time, and go on with what was written."""
    path = f"{folder.rstrip('/')}/{uuid4().hex}"
    checked.rejected.write.partitionBy("source").parquet(path)
    spark = checked.rows.sparkSession
    return Checked(checked.rows, spark.read.schema(REJECTED).parquet(path).select(*REJECTED.names))


def read_jdbc_table(spark: SparkSession, url: str, table: str, schema, split_on: str | None = None,
                    bounds: tuple[int, int] | None = None, splits: int = 1, **options) -> DataFrame:
    """An operational table over JDBC, read in ``splits`` key ranges when a split column is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_on and bounds:
        reader = reader.options(
            partitionColumn=split_on, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(splits)
        )
    df = reader.load()
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_optional(spark: SparkSession, path: str, schema, fmt: str = "csv", **options) -> DataFrame:
    """A feed that may not have landed: a missing path or one without files gives an empty frame."""
    if not _has_data(spark, path):
        return schemas.empty(spark, schema)
    return read_table(spark, path, schema, fmt, **options)


def _has_data(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        summary = fs.getContentSummary(p)
    except Exception as e:  # py4j wraps FileNotFoundException
        if "FileNotFoundException" in str(e):
            return False
        raise
    return summary.getLength() > 0


FEEDS = {"freight": ("freight_invoices", schemas.FREIGHT), "listings": ("listings", schemas.LISTINGS), "weather": ("weather", schemas.WEATHER)}


def read_sources(spark: SparkSession, path: str, fmt: str = "parquet", quarantine: str | None = None) -> Landed:
    """All operational tables and normalised feeds below one folder.

    With ``quarantine``, bad records of the CSV feeds are written there instead of stopping the read, and the gate
    of a build counts them.
    """
    base = path.rstrip("/")
    tables = {n: read_table(spark, f"{base}/{n}", s, fmt) for n, s in schemas.OPERATIONAL.items()}
    if quarantine is None:
        return Landed(spark, **tables, **{n: read_optional(spark, f"{base}/{f}", s) for n, (f, s) in FEEDS.items()})
    feeds = {n: quarantined(read_checked(spark, f"{base}/{f}", s, n), f"{quarantine.rstrip('/')}/{n}") for n, (f, s) in FEEDS.items()}
    rejected = reduce(DataFrame.unionByName, [c.rejected for c in feeds.values()])
    return Landed(spark, **tables, **{n: c.rows for n, c in feeds.items()}, rejected=rejected)


# -- partner feed ---------------------------------------------------------------------

_DOCUMENTS = {
    "invoice_page": schemas.INVOICE_PAGE,
    "invoice": schemas.INVOICE,
    "carrier": schemas.CARRIER,
    "surcharge": schemas.SURCHARGE,
    "weather": schemas.WEATHER_DOC,
}


def parse_documents(df: DataFrame, text: str, kind: str) -> DataFrame:
    """JSON documents of a known kind, one per row of column ``text``, as columns."""
    doc = F.from_json(text, _DOCUMENTS[kind], {"mode": "FAILFAST"})
    return df.select(doc.alias("doc")).select("doc.*")


def invoices_of_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("data").alias("invoice")).select("invoice.*")


def _rupees(paise: str) -> Column:
    return (F.col(paise).cast("decimal(18,0)") / F.lit(100)).cast(schemas.RUPEES)


def normalise_invoices(invoices: DataFrame) -> DataFrame:
    """Paise to rupees (NULL stays NULL), UTC creation time to the operating zone, dates typed."""
    created = D.strict_timestamp(F.col("created_at_utc"), D.FEED_FORMATS["PARTNER_API"])
    return invoices.select(
        "invoice_id", "carrier_id", "carrier_name", "warehouse_code", "route_code",
        F.col("invoice_date").cast("date").alias("invoice_date"),
        F.col("service_date").cast("date").alias("service_date"),
        _rupees("amount").alias("amount_inr"),
        "fuel_surcharge_pct",
        _rupees("detention_charge").alias("detention_charge_inr"),
        "distance_km", "weight_kg", "temperature_controlled", "status",
        D.utc_to_operating_zone(created).alias("created_at_ist"),
    )


def flatten_carriers(carriers: DataFrame) -> DataFrame:
    return carriers.withColumn("regions", F.concat_ws("|", "regions"))


def month_series(df: DataFrame, first: str, last: str) -> DataFrame:
    """Every month from the one of column ``first`` to the one of column ``last``, per row of ``df``."""
    months = F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))
    return df.select(F.explode(months).alias("d")).select(D.month_key(F.col("d")).alias("month"))


def surcharge_table(months: DataFrame, records: DataFrame) -> DataFrame:
    """One row per month of the series; a month without a landed record has a NULL surcharge."""
    return months.join(records, "month", "left").select("month", "surcharge_pct")


# -- weather --------------------------------------------------------------------------


def weather_days(docs: DataFrame) -> DataFrame:
    """Parallel daily arrays to one row per city and day, as far as the shortest array goes."""
    daily = [F.col("daily.time"), F.col("daily.temperature_2m_max"), F.col("daily.precipitation_sum")]
    shortest = F.least(*[F.size(c) for c in daily])
    zipped = F.arrays_zip(*[F.slice(c, 1, shortest) for c in daily])
    return docs.select("city", F.inline(zipped).alias("date", "temp_max_c", "precipitation_mm")).select(
        "city", F.col("date").cast("date").alias("date"), "temp_max_c", "precipitation_mm"
    )

"""Incremental invoice ingest: landed files in, each invoice once, restartable.

The file source's checkpoint knows which files are done, so a killed run goes on where
it stopped. A checkpoint is a run; every micro-batch writes the folder of its run and
number and overwrites only that when replayed, so a crash between write and commit
duplicates nothing, and a new checkpoint on an old table adds to it. An invoice that
lands again, in the same batch or years later, is dropped: within a batch by an aggregate
that combines on the map side (a page landed a million times does not pile up in one
task), across batches by an anti join with the ids already there.

The table is its own index of ids. It is partitioned by the month in which an invoice was
created and by a hash of its id, and a batch reads the ids of its own partitions only: of
its hash buckets always, and of its months if ``created_is_final``. Then a daily feed looks
into the current month however long the history is, and an invoice that lands again years
late is still found, in its month. There is no second copy that could fall behind, and no
streaming state that grows or forgets.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import dates as D
from ..session import folder_names, text_once
from ..sources import landed

RUN, LAYOUT = "ingest-run", "_id_buckets"


def one_per_invoice(invoices: DataFrame) -> DataFrame:
    """The first created record of each invoice; equal ones in column order, so reruns agree."""
    rest = [c for c in invoices.columns if c not in ("invoice_id", "created_at_ist")]
    first = F.min(F.struct("created_at_ist", *rest)).alias("r")
    return invoices.groupBy("invoice_id").agg(first).select("invoice_id", "r.*").select(*invoices.columns)


def placed(invoices: DataFrame, id_buckets: int) -> DataFrame:
    """Invoices with the partition they are stored under."""
    month = F.coalesce(D.month_key(F.col("created_at_ist")), F.lit("unknown"))
    bucket = F.pmod(F.xxhash64("invoice_id"), F.lit(id_buckets)).cast("int")
    return invoices.withColumns({"created_month": month, "id_bucket": bucket})


MOST_PLACES = 1_000


def stored_ids(fresh: DataFrame, out: str, created_is_final: bool = False) -> DataFrame:
    """What is stored in the partitions where the invoices of ``fresh`` could be: id, run and batch.

    The partitions are listed as literals, so files of others are not even opened. Without
    ``created_is_final`` they are the buckets of all months. Beyond ``MOST_PLACES`` months
    (a feed of junk dates) all are read, and the join decides.
    """
    table = stored(fresh.sparkSession, out)
    buckets = [r[0] for r in fresh.select("id_bucket").distinct().collect()]  # as many as the table has, at most
    table = table.where(F.col("id_bucket").isin(buckets))
    if created_is_final:
        months = [r[0] for r in fresh.select("created_month").distinct().limit(MOST_PLACES + 1).collect()]
        if len(months) <= MOST_PLACES:
            table = table.where(F.col("created_month").isin(months))
    return table.select("invoice_id", "run", "batch_id")


def _unseen(fresh: DataFrame, out: str, run: str, batch_id: int, created_is_final: bool) -> DataFrame:
    """Invoices that no other batch of any run has stored."""
    if not any_stored(fresh.sparkSession, out):
        return fresh
    done = stored_ids(fresh, out, created_is_final).where((F.col("run") != run) | (F.col("batch_id") != batch_id))
    # Stored ids are cut down to the batch's first: with a small batch the stored side is not shuffled.
    again = done.select("invoice_id").join(fresh.select("invoice_id"), "invoice_id", "left_semi").distinct()
    return fresh.join(again, "invoice_id", "left_anti")


def store_batch(
    out: str, run: str, *, created_is_final: bool = False, id_buckets: int = 1
) -> Callable[[DataFrame, int], None]:
    """The sink of one micro-batch of normalised invoices, for the run of that id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        buckets = int(text_once(batch.sparkSession, f"{out}/{LAYOUT}", str(id_buckets)))
        fresh = placed(one_per_invoice(batch), buckets).persist()
        try:
            (
                _unseen(fresh, out, run, batch_id, created_is_final)
                .hint("rebalance", F.col("created_month"), F.col("id_bucket"))
                .write.mode("overwrite")
                .partitionBy("created_month", "id_bucket")
                .parquet(f"{out}/run={run}/batch_id={batch_id}")
            )
        finally:
            fresh.unpersist()

    return write


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of a checkpoint's run. It lies in the checkpoint, so it goes on and ends with it."""
    return text_once(spark, f"{checkpoint.rstrip('/')}/{RUN}", uuid4().hex)


def ingest(
    stream: DataFrame, out: str, checkpoint: str, *, created_is_final: bool = False, id_buckets: int = 1, wait: bool = True
):
    """Run what has landed through to ``out`` and stop; call again for what lands later.

    ``stream`` is a streaming frame of partner invoices (``schemas.INVOICE``). With
    ``created_is_final`` the caller vouches that an invoice that lands again was created in
    the same month; a batch then looks up its own months of the table only. A new table is
    split into ``id_buckets`` by id within a month, and keeps that number; one for every
    million invoices a month is about right.
    """
    run = run_of(stream.sparkSession, checkpoint)
    query = (
        landed.normalise_invoices(stream)
        .writeStream.foreachBatch(store_batch(out.rstrip("/"), run, created_is_final=created_is_final, id_buckets=id_buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


def landed_pages(
    spark: SparkSession, path: str, files_per_batch: int = 1000, page_per_file: bool = False
) -> DataFrame:
    """Streaming frame of the invoices in landed JSON page documents, one per line or one per file."""
    pages = (
        spark.readStream.schema(schemas.INVOICE_PAGE)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("multiLine", page_per_file)
        .json(path)
    )
    return landed.invoices_of_pages(pages)


def any_stored(spark: SparkSession, out: str) -> bool:
    """Whether a batch of any run was begun."""
    return bool(folder_names(spark, out, "run="))


def stored(spark: SparkSession, out: str) -> DataFrame:
    """All invoices ingested so far."""
    return spark.read.schema(schemas.STORED_FREIGHT).parquet(out.rstrip("/"))

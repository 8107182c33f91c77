"""Outlets that are one business: records linked by tax number or position, each group with a survivor.

The duplicate flag of ``dims.outlet`` looks at one identity of a record. Here records are linked by either, directly or
through others, so a record with the tax number of one and the position of another joins the two. Only records that share
a key take part in the rounds; a round is a few groupings that add up on the map side and lookups that spread hot keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_once
from .dims import is_test_name
from .skew import looked_up


def outlet_keys(gst: Column, latitude: Column, longitude: Column) -> dict[str, Column]:
    """The keys by which records are linked; an empty tax number is none, a position needs both coordinates."""
    return {"by_tax": F.when(gst != "", gst), "by_point": F.concat(latitude.cast("string"), F.lit(","), longitude.cast("string"))}


def linked_rows(df: DataFrame, row_id: str, keys: dict[str, Column]) -> DataFrame:
    """``row_id``, ``entity_id`` of the rows that share a key with another row: the smallest id reachable through shared keys.

    Rows of one id are one row. Every row holds the smallest id it knows of. In a round the smallest id of its keys' rows
    reaches a row and the row whose id it held before, then each takes over what the row of its id holds, so distances
    halve. A round is a written table: a lost executor repeats one round at most.
    """
    known = df.select(F.col(row_id).alias("id"), *[c.alias(k) for k, c in keys.items()]).where("id IS NOT NULL")
    pairs = known.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("key")) for i, k in enumerate(keys)])).alias("k"))
    pairs = pairs.where("k.key IS NOT NULL").select("id", "k.kind", "k.key")
    shared = pairs.groupBy("kind", "key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    # Every row is linked with the first of its key, so a key of n rows has n - 1 links.
    whole = F.concat(F.col("kind").cast("string"), F.lit(":"), F.col("key")).alias("key")
    hubs = looked_up(pairs.select("id", whole), "key", shared.select(whole, F.col("first").alias("hub")))
    links = written_once(hubs.where("hub IS NOT NULL AND hub <> id").select("id", "hub").distinct())
    ends = links.select("id").union(links.select(F.col("hub").alias("id"))).distinct()
    now = written_once(ends.select("id", F.col("id").alias("entity_id")))
    while True:
        held = now.select(F.col("id").alias("hub"), F.col("entity_id").alias("hub_entity"))
        both = looked_up(links.join(now, "id"), "hub", held)
        told = both.select("id", F.col("hub_entity").alias("least")).union(both.select(F.col("hub").alias("id"), F.col("entity_id").alias("least")))
        best = told.groupBy("id").agg(F.min("least").alias("least"))
        heard = now.join(best, "id").select("id", "entity_id", F.least("entity_id", "least").alias("least"))
        # The row whose id was held hears of it as well.
        passed = heard.groupBy(F.col("entity_id").alias("id")).agg(F.min("least").alias("passed"))
        step = written_once(heard.join(passed, "id", "left").select("id", "entity_id", F.least("least", "passed").alias("least")))
        jump = looked_up(step, "least", step.select(F.col("id").alias("least"), F.col("least").alias("next")))
        again = written_once(jump.select("id", F.least("least", "next").alias("entity_id"), F.col("entity_id").alias("before")))
        now = again.select("id", "entity_id")
        if again.where("entity_id <> before").isEmpty():
            return now.select(F.col("id").alias(row_id), "entity_id")


def outlet_entities(raw: DataFrame) -> DataFrame:
    """``outlet_id``, ``entity_id``, ``n_outlets``, ``survivor_id``, ``is_survivor`` of every outlet.

    The entity is named by its smallest outlet id. Its survivor is the record that is not deleted, is no test outlet and
    has a tax number, in this order of weight, and the smallest id among equals. An outlet without links is its own
    entity; one without an id has neither entity nor survivor.
    """
    keys = outlet_keys(F.col("gst_number"), F.col("latitude"), F.col("longitude"))
    linked = linked_rows(raw, "outlet_id", keys)
    rank = [F.coalesce(F.col("is_deleted") != 0, F.lit(True)), F.coalesce(is_test_name(F.col("outlet_name")), F.lit(True)), keys["by_tax"].isNull()]
    ranked = raw.select("outlet_id", reduce(lambda a, b: a * 2 + b, [r.cast("int") for r in rank]).alias("faults"))
    rows = ranked.join(linked, "outlet_id", "left").withColumn("entity_id", F.coalesce("entity_id", "outlet_id"))
    best = rows.where("outlet_id IS NOT NULL").groupBy("entity_id").agg(
        F.min(F.struct("faults", "outlet_id")).alias("best"), F.count(F.lit(1)).alias("n_outlets")
    )
    best = best.where("n_outlets > 1").select("entity_id", F.col("best.outlet_id").alias("survivor_id"), "n_outlets")
    out = looked_up(rows, "entity_id", best)
    survivor = F.coalesce("survivor_id", "outlet_id")
    return out.select(
        "outlet_id", "entity_id", F.coalesce("n_outlets", F.lit(1)).cast("bigint").alias("n_outlets"), survivor.alias("survivor_id"),
        (survivor == F.col("outlet_id")).alias("is_survivor"),
    )

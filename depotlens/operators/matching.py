"""Competitor listings matched to own SKUs by brand, category and pack size.

A listing's candidates are the products of its brand and category whose normalised pack
is within half a base unit. Listing/product pairs are never formed: at scale one brand
and category may hold a third of either side. Instead

* both sides are reduced to *cells* (brand, category, family, pack), and only cells are
  joined on the pack band;
* per listing cell that gives the number of candidates and the lowest candidate;
* the tiebreak (does a word of the product name occur in the title?) runs on distinct
  title tokens against distinct name words, and only where there are several candidates.

Every candidate counts; nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import numeric as N

BAND = 0.5
MIN_WORD = 4
STRETCH = 256

CELL = ("cell_brand", "cell_category", "cell_family", "cell_pack")


def _cell(brand: str, category: str, value: str, uom: str, strict_family: bool) -> dict[str, Column]:
    family = N.pack_family(F.col(uom)) if strict_family else F.lit("any")
    return {
        "cell_brand": F.col(brand),
        "cell_category": F.col(category),
        "cell_family": family,
        "cell_pack": N.pack_in_base_units(F.col(value), F.col(uom)),
    }


def _has_cell() -> Column:
    cond = F.lit(True)
    for c in CELL:
        cond = cond & F.col(c).isNotNull()
    return cond


def _pick() -> Column:
    """What is kept of the best candidate; ordered by product id, so ``min`` finds the lowest."""
    return F.struct("product_id", "sku_code", "own_mrp_inr")


def _products(dim_product: DataFrame, strict_family: bool) -> DataFrame:
    return (
        dim_product.withColumns(_cell("brand", "category", "pack_size_value", "pack_size_uom", strict_family))
        .where(_has_cell())
        .select(*CELL, "product_id", "sku_code", "product_name", F.col("mrp_inr").alias("own_mrp_inr"))
    )


def _cell_pairs(listing_cells: DataFrame, product_cells: DataFrame) -> DataFrame:
    """Listing cells with the product cells in their band.

    A product cell is filed under its whole unit, a listing cell asks for its own and
    the two next to it, which makes the band an equi-join.
    """
    asked = listing_cells.withColumn(
        "unit", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor("cell_pack") + d))
    )
    filed = product_cells.withColumn("unit", F.floor("cell_pack")).withColumnRenamed("cell_pack", "product_pack")
    return (
        asked.join(filed, ["cell_brand", "cell_category", "cell_family", "unit"])
        .where(F.abs(F.col("product_pack") - F.col("cell_pack")) < BAND)
        .drop("unit")
    )


def _name_words(products: DataFrame) -> DataFrame:
    """Distinct eligible upper-case name words per product cell with their lowest product."""
    return (
        products.withColumn("word", F.explode(F.split("product_name", " ")))
        .where((F.length("word") >= MIN_WORD) & (F.upper("word") != F.upper("cell_brand")))
        .groupBy(*CELL, F.upper("word").alias("word"))
        .agg(F.min(_pick()).alias("by_word"))
    )


def _title_tokens(listings: DataFrame) -> DataFrame:
    """Name words hold no blank, so a word lies in the title iff it lies in one of its tokens."""
    return listings.withColumn("token", F.explode(F.array_distinct(F.split(F.upper("title"), " ")))).where(
        F.length("token") >= MIN_WORD
    )


def price_position(
    listings: DataFrame,
    dim_product: DataFrame,
    strict_family: bool = True,
    listing_key: tuple[str, ...] = ("city", "listing_id"),
) -> DataFrame:
    """One row per listing: best own SKU, price gap, and ``matched`` / ``ambiguous`` / ``unmatched``.

    ``strict_family`` keeps weights and volumes apart. A listing seen several times is
    one listing, whose candidates add up.
    """
    products = _products(dim_product, strict_family)
    product_cells = products.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_products"), F.min(_pick()).alias("lowest")
    )

    every = listings.withColumns(_cell("brand_guess", "category", "pack_value", "pack_uom", strict_family))
    seen = every.where(_has_cell())

    pairs = _cell_pairs(seen.select(*CELL).distinct(), product_cells)
    cells = pairs.groupBy(*CELL).agg(F.sum("n_products").alias("n_candidates"), F.min("lowest").alias("lowest"))

    # Tiebreak, only for cells with a choice. Words are filed under the listing cell that asks for them.
    words = _name_words(products).withColumnRenamed("cell_pack", "product_pack")
    contested = cells.where("n_candidates > 1").select(*CELL)
    asked_words = (
        pairs.select(*CELL, "product_pack")
        .join(contested, list(CELL), "left_semi")
        .join(words, ["cell_brand", "cell_category", "cell_family", "product_pack"])
        .groupBy(*CELL, "word")
        .agg(F.min("by_word").alias("by_word"))
    )
    # Tokens are made distinct before they meet the cells: joined by cell first, all tokens of a
    # hot cell would stay together in the aggregation that follows.
    title_key = [*CELL, "title"]
    tokens = _title_tokens(seen.select(*title_key).distinct())
    # A token is cut to pieces of the lengths that its cell's words have, one row per piece: as
    # many as its letters, per length, however long the token is.
    # Long tokens go by stretches first, as finding a place in a text takes as long as the text before it.
    lengths = asked_words.select(*CELL, F.length("word").alias("size")).distinct()
    stretch = F.explode(F.sequence(F.lit(1), F.length("token") - F.col("size") + 1, F.lit(STRETCH)))
    begin = F.explode(F.sequence(F.lit(1), F.length("part") - F.col("size") + 1))
    hits = (
        tokens.select(*CELL, "token")
        .distinct()
        .join(lengths, list(CELL))
        .where(F.length("token") >= F.col("size"))
        .select(*CELL, "token", "size", stretch.alias("at"))
        .withColumn("part", F.substring("token", F.col("at"), F.col("size") + (STRETCH - 1)))
        .select(*CELL, "token", "size", "part", begin.alias("begin"))
        .withColumn("word", F.substring("part", F.col("begin"), F.col("size")))
        .join(asked_words, [*CELL, "word"])
        .groupBy(*CELL, "token")
        .agg(F.min("by_word").alias("by_token"))
    )
    named = tokens.join(hits, [*CELL, "token"]).groupBy(*title_key).agg(F.min("by_token").alias("by_name"))

    # Listings without a cell have no candidate; they stay out of the joins, where their missing
    # keys would all meet.
    found = seen.join(cells, list(CELL), "left").join(named, title_key, "left")
    scored = (
        found.unionByName(every.where(~_has_cell()), allowMissingColumns=True)
        .withColumn("n_candidates", F.coalesce("n_candidates", F.lit(1)))
        .withColumn("best", F.coalesce("by_name", "lowest"))
        # Ordered so that the smallest is the best: a match, by name, the lowest product.
        .withColumn(
            "rank",
            F.struct(
                F.col("best").isNull().alias("no_match"),
                F.col("by_name").isNull().alias("not_by_name"),
                F.col("best.product_id").alias("product_id"),
                F.col("price_inr"),
            ),
        )
    )
    carried = ("retailer", "title", "brand_guess", "category", "price_inr", "mrp_inr", "stock_status", "last_seen")
    kept = F.struct("rank", "best", *carried)
    per_listing = (
        scored.groupBy(*listing_key)
        .agg(F.sum("n_candidates").alias("n_candidates"), F.min(kept).alias("k"))
        .select(*listing_key, "n_candidates", *[F.col(f"k.{c}").alias(c) for c in carried], F.col("k.best").alias("best"))
    )
    sku, own = F.col("best.sku_code"), F.col("best.own_mrp_inr")
    gap = own - F.col("price_inr")
    return per_listing.select(
        "listing_id", "city", "retailer", "title", "brand_guess", "category", "price_inr", "mrp_inr", "stock_status",
        F.col("last_seen").cast("date").alias("last_seen"),
        sku.alias("sku_code"),
        own.alias("own_mrp_inr"),
        gap.alias("mrp_gap_inr"),
        N.share_pct(gap, own, 1).alias("mrp_gap_pct"),
        F.when(sku.isNull(), "unmatched").when(F.col("n_candidates") > 1, "ambiguous").otherwise("matched")
        .alias("match_confidence"),
        "n_candidates",
    )


def match_profile(fact_price_position: DataFrame) -> DataFrame:
    return fact_price_position.groupBy("match_confidence").agg(F.count(F.lit(1)).alias("n_listings"))

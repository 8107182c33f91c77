"""Competitor listings out of raw city pages: split into cards, then one column per field.

All of it is regular expressions inside the plan. A card without a title link is dropped.
"""

from __future__ import annotations

import json
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas

# The page markup.
CARD_START = r'<div class="card product-item" data-listing-id="(\d+)">'
PAGE_COUNT = r"(?i)page \d+ of (\d+)"
MONEY = r"[\d,]+\.?\d*"
TITLE_LINK = r'<a href="(/product/\d+\.html)"><strong>(.*?)</strong></a>'
FIRST_MUTED = r'</a>\s*<div class="muted">(.*?)</div>'
PRICE_SPAN = r'<span class="price">(.*?)</span>'
PRICE_PAISE = r'<span class="pricing-block" data-price-paise="(\d+)"'
PRICE_AMOUNT = r'<div class="amt">.*?([\d,]+\.?\d*)\s*<small>'
PRICE_SELLING = r'<b class="sellingPrice">INR\s*([\d,]+\.?\d*)</b>'
MRP_AND_STOCK = r'<div class="muted">(MRP.*?)</div>'
LAST_SEEN = r"Last seen: ([\d-]+)"
RATED = r"^rated ([\d.]+) \((\d+)\)"
PACK = r"(?i)^([\d.]+)\s*(g|kg|ml|l)\b"
SEPARATOR = "&middot;"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """First match's group, NULL when there is no match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _found_even_empty(text: Column, pattern: str) -> Column:
    """First match's group, NULL only when there is no match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def _char(code: Column) -> Column:
    """The character of a code point (built from its UTF-32 bytes); NULL if there is none."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _named_characters() -> Column:
    """HTML 4 names to characters, from the table of the standard library."""
    names = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # folded to a constant


def unescaped(text: Column) -> Column:
    """HTML character references replaced, numeric and named; they must end in a semicolon.

    Each part after an ampersand is looked at on its own, so nothing is replaced twice.
    """
    named = _named_characters()

    def decode(p: Column) -> Column:
        ref, part = p["ref"], p["part"]
        hexa = F.conv(F.substr(ref, F.lit(3)), 16, 10).cast("int")
        char = (
            F.when(ref == "", F.lit(None))
            .when(ref.rlike("^#[xX]"), _char(hexa))
            .when(ref.startswith("#"), _char(F.substr(ref, F.lit(2)).try_cast("int")))
            .otherwise(F.try_element_at(named, ref))
        )
        return F.coalesce(F.concat(char, F.substr(part, F.length(ref) + 2)), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    tail = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    refs = F.transform(tail, lambda p: F.struct(F.regexp_extract(p, _REFERENCE, 1).alias("ref"), p.alias("part")))
    decoded = F.concat(F.element_at(parts, 1), F.array_join(F.transform(refs, decode), ""))
    return F.when(text.contains("&"), decoded).otherwise(text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def money(text: Column) -> Column:
    """First number of a text, thousands separators removed; NULL if there is none."""
    digits = F.regexp_extract(unescaped(text), MONEY, 0)
    return F.regexp_replace(digits, ",", "").try_cast(schemas.MONEY)


def guess_brand(title: Column, brands: tuple[str, ...]) -> Column:
    """The first brand of the list that occurs in the title, whatever the case."""
    upper = F.upper(title)
    return F.coalesce(*[F.when(upper.contains(b.upper()), F.lit(b)) for b in brands])


def cards(pages: DataFrame) -> DataFrame:
    """One row per card of ``(city, url, html)`` pages. A card reaches to the next one's start."""
    split = F.split("html", rf"(?={CARD_START})")
    card = F.col("card")
    return (
        pages.withColumn("card", F.explode(split))
        .where(card.rlike("^" + CARD_START) & card.rlike(TITLE_LINK))
        .select("city", F.col("url").alias("source_url"), "card")
    )


def _details(card: Column) -> Column:
    """The blank-stripped parts of the MRP and stock line."""
    return F.transform(F.split(_found(card, MRP_AND_STOCK), SEPARATOR), lambda p: stripped(unescaped(p)))


def _last_where(parts: Column, condition) -> Column:
    """Later parts win, as in a loop over them."""
    return F.try_element_at(F.filter(parts, condition), F.lit(-1))


def extract(pages: DataFrame, brands: tuple[str, ...]) -> DataFrame:
    """Listings of ``(city, url, html)`` pages; fields that a card lacks are NULL."""
    card = F.col("card")
    base = cards(pages).select(
        "city",
        "source_url",
        F.regexp_extract(card, "^" + CARD_START, 1).alias("listing_id"),
        F.regexp_extract(card, TITLE_LINK, 1).alias("product_detail_url"),
        stripped(unescaped(F.regexp_extract(card, TITLE_LINK, 2))).alias("title"),
        F.transform(F.split(_found_even_empty(card, FIRST_MUTED), SEPARATOR), lambda p: stripped(unescaped(p))).alias("meta"),
        money(_found(card, PRICE_SPAN)).alias("p_span"),
        (_found(card, PRICE_PAISE).cast("decimal(18,0)") / F.lit(100)).cast(schemas.MONEY).alias("p_paise"),
        money(_found(card, PRICE_AMOUNT)).alias("p_amount"),
        money(_found(card, PRICE_SELLING)).alias("p_selling"),
        card.rlike(PRICE_SPAN).alias("has_span"),
        _found(card, PRICE_AMOUNT).isNotNull().alias("has_amount"),
        _found(card, PRICE_SELLING).isNotNull().alias("has_selling"),
        _details(card).alias("details"),
        _found(card, LAST_SEEN).alias("last_seen"),
    )
    # A markup that is there but holds no number leaves its name as the source, unless a later one is there too.
    sources = [
        ("b.sellingPrice", F.col("p_selling").isNotNull(), F.col("has_selling")),
        ("div.amt", F.col("p_amount").isNotNull(), F.col("has_amount")),
        ("pricing-block(paise)", F.col("p_paise").isNotNull(), F.col("p_paise").isNotNull()),
        ("span.price", F.col("p_span").isNotNull(), F.col("has_span")),
    ]
    priced = reduce(lambda rest, s: F.when(s[1], F.lit(s[0])).otherwise(rest), sources, F.lit(None).cast("string"))
    tried = F.coalesce(*[F.when(s[2], F.lit(s[0])) for s in sources])
    details = F.col("details")
    mrp = _last_where(details, lambda p: p.startswith("MRP"))
    stock = _last_where(
        details,
        lambda p: ~p.startswith("MRP")
        & (F.lower(p).startswith("in stock") | F.lower(p).startswith("currently unavailable")),
    )
    rated = _last_where(details, lambda p: p.rlike(RATED))
    pack = F.try_element_at("meta", F.lit(2))
    return base.select(
        "listing_id", "city", "product_detail_url", "title",
        guess_brand(F.col("title"), brands).alias("brand_guess"),
        F.try_element_at("meta", F.lit(1)).alias("retailer"),
        pack.alias("pack_raw"),
        _found(pack, PACK, 1).try_cast("double").alias("pack_value"),
        F.upper(_found(pack, PACK, 2)).alias("pack_uom"),
        F.try_element_at("meta", F.lit(3)).alias("category"),
        F.coalesce("p_span", "p_paise", "p_amount", "p_selling").alias("price_inr"),
        F.coalesce(priced, tried).alias("price_source"),
        money(mrp).cast(schemas.RUPEES).alias("mrp_inr"),
        F.when(F.lower(stock).startswith("in stock"), "IN_STOCK")
        .when(stock.isNotNull(), "UNAVAILABLE")
        .alias("stock_status"),
        _found(rated, RATED, 1).try_cast("double").alias("rating"),
        _found(rated, RATED, 2).try_cast("int").alias("rating_count"),
        "last_seen", "source_url",
    )


def declared_pages(html: Column) -> Column:
    return F.coalesce(_found(html, PAGE_COUNT).try_cast("int"), F.lit(1))


def page_coverage(pages: DataFrame) -> DataFrame:
    """Per city: pages declared, pages landed, pages missing."""
    return (
        pages.groupBy("city")
        .agg(F.max(declared_pages(F.col("html"))).alias("pages_declared"), F.countDistinct("url").alias("pages_seen"))
        .withColumn("pages_missing", F.greatest(F.col("pages_declared") - F.col("pages_seen"), F.lit(0)))
    )


def unparsed_prices(listings: DataFrame) -> DataFrame:
    """One row: listings, and how many of them have no price."""
    return listings.agg(
        F.count(F.lit(1)).alias("n_listings"), F.count_if(F.col("price_inr").isNull()).alias("n_without_price")
    )

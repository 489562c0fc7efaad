"""Keys made of text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def match_key(text: pd.Series) -> pd.Series:
    """NFKC, without white space, case folded: Spark has no such normal form."""
    return text.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFKC", t).split()).casefold())


def is_ean13(text: Column) -> Column:
    """Thirteen digits whose last one is right: digits weigh 1 and 3 in turn."""
    digits = F.transform(F.split(F.substring(text, 1, 12), ""), lambda d, i: d.try_cast("int") * F.when(i % 2 == 0, 1).otherwise(3))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + d)
    return F.coalesce(text.rlike("^[0-9]{13}$") & ((10 - total % 10) % 10 == F.substring(text, 13, 1).try_cast("int")), F.lit(False))


def spaced(text: Column) -> Column:
    """Each run of white space as one space, none at the ends; NULL is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def sku_text(value: Column) -> Column:
    """An identifier as text, trimmed; NULL is empty."""
    return F.coalesce(F.trim(value.cast("string")), F.lit(""))


def number_sku_text(value: Column) -> Column:
    """An identifier that came as a number, without the zeros after its point."""
    text = value.cast("string")
    return F.coalesce(F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text), F.lit(""))


def product_identity(name: Column, variation: Column) -> Column:
    """(name, variation): a ``variation:`` inside the name fills a blank variation and leaves the name."""
    plain, own = spaced(name), spaced(variation)
    marked = r"(?i)^(.*?)(?:\s+|^)variation\s*:\s*(.+)$"
    inside = F.regexp_extract(plain, marked, 2)
    own = F.when(own == "", inside).otherwise(own)
    label = F.regexp_extract(own, r"(?i)^variation\s*:\s*(.+)$", 1)
    return F.struct(spaced(F.when(plain.rlike(marked), F.regexp_extract(plain, marked, 1)).otherwise(plain)).alias("name"), spaced(F.when(label != "", label).otherwise(own)).alias("variation"))


def without_amount(variation: Column, amount: Column) -> Column:
    """The variation without an amount at its end, where that is the confirmed one and something is left."""
    pattern = r"(?i)^(.*?)\s+((?:RM\s*)?[0-9]{1,6}(?:,[0-9]{3})*\.[0-9]{2})\s*$"
    token = F.regexp_replace(F.regexp_extract(variation, pattern, 2), "(?i)RM|,", "")
    rest = spaced(F.regexp_extract(variation, pattern, 1))
    return F.when(F.coalesce(F.trim(token).try_cast("decimal(18,2)") == amount, F.lit(False)) & (rest != ""), rest).otherwise(variation)


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC, case folded; Spark has neither."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def plain_or(text: Column, normal: Callable[[Column], Column]) -> Column:
    """Lower case where the text is ASCII, which needs no other normal form; else ``normal``, in Python."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    return F.when(ascii_only, F.lower(text)).otherwise(normal(F.when(~ascii_only, text)))


def statement_name(text: Column) -> Column:
    """Comparison key of a statement's product name: a lone ampersand is "and", inner spaces stay."""
    return spaced(F.regexp_replace(plain_or(F.coalesce(text, F.lit("")), compatible), r"(?<!\w)&(?!\w)", " and "))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFKC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Word breaks of the source layout and their repairs; the characters between which a gap is layout, too.
BROKEN_WORDS = (("F ree", "Free"), ("Ba sed", "Based"), ("Be st", "Best"))
UNSPACED = r"[\u3400-\u9fff]"


def title(text: Column) -> Column:
    """A product title for display, from its compatibility form: without a pre-order mark in front, broken words whole again, no
    gap inside unspaced scripts, and single spaces elsewhere."""
    ascii_only = text.rlike(r"^\p{ASCII}*$")
    form = F.trim(F.when(ascii_only, text).otherwise(composed(F.when(~ascii_only, text))))
    named = F.regexp_replace(form, r"^(?i:pre-order)\s+", "")
    whole = reduce(lambda out, repair: F.replace(out, *map(F.lit, repair)), BROKEN_WORDS, named)
    return spaced(F.regexp_replace(whole, rf"({UNSPACED})\s+(?={UNSPACED})", "$1"))


#: The platforms by their display names.
PLATFORMS = ("Shopee", "Lazada", "Zenxin")


def platform_label(text: Column) -> Column:
    """The platform's display name in any case; other text as it is, trimmed."""
    plain = sku_text(text)
    known = F.lit(None).cast("string")
    for name in PLATFORMS:
        known = F.coalesce(known, F.when(F.lower(plain) == name.lower(), F.lit(name)))
    return F.coalesce(known, plain)


def order_identity(platform: Column, order_id: Column) -> Column:
    """(platform, order_id), or NULL where either is blank or the id is N/A; unknown platforms in lower case."""
    label, own = platform_label(platform), sku_text(order_id)
    usable = (label != "") & (own != "") & (F.lower(own) != "n/a")
    return F.when(usable, F.struct(F.when(label.isin(*PLATFORMS), label).otherwise(F.lower(label)).alias("platform"), own.alias("order_id")))


def first_present(*values: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def or_placeholder(text: Column, placeholder: str = "N/A") -> Column:
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(placeholder))


def barcode(sku: Column) -> Column:
    """What stands before the first hyphen, if it is an EAN-13."""
    code = F.substring_index(F.trim(sku), "-", 1)
    return F.when(is_ean13(code), code)


def bundle(sku: Column, quantity: Column) -> Column:
    """(status, multiplier, pos_quantity) by the number after the last hyphen.

    NORMAL without such a number, CONFIRMED_BUNDLE with one, REVIEW_REQUIRED where it is 0, nothing
    stands before it, or the quantity isn't positive.
    """
    plain = F.trim(sku)
    suffix = F.regexp_extract(plain, "-([0-9]+)$", 1)
    multiplier = suffix.try_cast("long")
    prefix = F.regexp_replace(plain, "-[0-9]+$", "")
    status = F.when(suffix == "", "NORMAL").when((prefix == "") | (multiplier <= 0) | (quantity <= 0), "REVIEW_REQUIRED").otherwise("CONFIRMED_BUNDLE")
    confirmed = status == "CONFIRMED_BUNDLE"
    pos = F.when(confirmed, quantity * multiplier).when((status == "NORMAL") & (quantity > 0), quantity.cast("long"))
    return F.struct(status.alias("status"), F.when(confirmed, multiplier).alias("multiplier"), pos.alias("pos_quantity"))


def price_override(status: Column, quantity: Column, discount: Column, amount: Column) -> Column:
    """(status, price): a unit price to type in, only where it gives the amount to the cent."""
    price = F.bround(amount / quantity, 2).cast("decimal(18,2)")
    kind = (
        F.when(status != "NORMAL", "BUNDLE_PRICE_REVIEW_REQUIRED")
        .when(discount >= 0, "NOT_REQUIRED")
        .when((quantity <= 0) | (price * quantity != amount), "ROUNDING_REVIEW_REQUIRED")
        .otherwise("OVERRIDE_REQUIRED")
    )
    return F.struct(kind.alias("status"), F.when(kind == "OVERRIDE_REQUIRED", price).alias("price"))


MOST_UNITS = 999


def sku_components(text: Column) -> Column:
    """The parts of a listing's SKU between semicolons, each as (original, identifier, kind, units, status).

    NAV:id and an EAN-13 may carry a number of units after a hyphen; other text after an EAN-13 is
    only context; anything else is a code that is typed in.
    """

    def one(part: Column) -> Column:
        original = F.trim(part)
        nav = r"(?i)^NAV\s*:\s*(.+?)(?:-([0-9]+))?$"
        nav_id, nav_units = F.trim(F.regexp_extract(original, nav, 1)), F.regexp_extract(original, nav, 2)
        code, rest = F.substring(original, 1, 13), F.regexp_extract(original, r"^[0-9]{13}-(.+)$", 1)
        is_nav, is_code = original.rlike(nav), is_ean13(code) & ((F.length(original) == 13) | (rest != ""))
        raw = F.when(is_nav, nav_units).when(is_code & rest.rlike("^[0-9]+$"), rest).otherwise("")
        units = F.when(raw == "", F.lit(1)).otherwise(raw.try_cast("int"))
        bad = (original == "") | ~F.coalesce(units.between(1, MOST_UNITS), F.lit(False)) | (is_nav & (nav_id == ""))
        kind = F.when(bad, "MANUAL_CODE").when(is_nav, "NAV").when(is_code, "EAN13").otherwise("MANUAL_CODE")
        status = F.when(bad, "REVIEW_REQUIRED").when(kind == "EAN13", "READY").otherwise("MANUAL_ENTRY_REQUIRED")
        identifier = F.when(kind == "NAV", nav_id).when(kind == "EAN13", code).otherwise(original)
        return F.struct(original.alias("original"), identifier.alias("identifier"), kind.alias("kind"), F.when(~bad, units).alias("units"), status.alias("status"))

    none = F.expr("cast(array() as array<struct<original:string,identifier:string,kind:string,units:int,status:string>>)")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", none).otherwise(F.transform(F.split(text, ";", -1), one))


def scan_quantity(quantity: Column, units: Column) -> Column:
    return F.when(quantity > 0, quantity * units)


#: The one kind of adjustment that keeps its historic name.
RETURN_REFUND = ("return refund adjustment after order completed", "RETURN_REFUND_AFTER_ORDER_COMPLETED")


def adjustment_type(text: Column) -> Column:
    """Upper case, other characters as one underscore each run, none at the ends; NULL if nothing is left."""
    kind = F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.lower(spaced(text)) == RETURN_REFUND[0], RETURN_REFUND[1]).otherwise(F.nullif(kind, F.lit("")))


def short_label(text: Column, longest: int = 42) -> Column:
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(plain) > longest, F.concat(F.rtrim(F.substring(plain, 1, longest - 1)), F.lit("…"))).otherwise(plain)


def period_label(start: Column, end: Column) -> Column:
    """The month's name for a whole month, else both dates."""
    whole = (F.dayofmonth(start) == 1) & (end == F.last_day(start))
    return F.when(whole, F.date_format(start, "MMMM yyyy")).otherwise(F.concat_ws(" → ", start.cast("string"), end.cast("string")))

"""Casts of text as people write it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def lenient_money(text: Column) -> Column:
    """NULL or blank is 0; separators and currency marks are dropped; else the first number, else 0."""
    plain = F.regexp_replace(F.trim(text), r"(RM|S\$|,)", "")
    first = F.regexp_extract(plain, r"-?[0-9]+(\.[0-9]+)?", 0)
    return F.coalesce(F.trim(plain).try_cast(MONEY), first.try_cast(MONEY), F.lit(0).cast(MONEY))


def lenient_quantity(text: Column) -> Column:
    """The first run of digits, once separators are dropped; 0 without one."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), ",", "")
    return F.coalesce(F.regexp_extract(plain, "[0-9]+", 0).try_cast("int"), F.lit(0))


def strict_price(text: Column) -> Column:
    """A whole price, with RM in front or not and digits grouped or not; NULL otherwise."""
    ok = F.trim(text).rlike(r"^(RM ?)?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]{1,2})?$")
    return F.when(ok, F.regexp_replace(text, "[RM, ]", "").try_cast(MONEY))


def statement_money(text: Column) -> Column:
    """Commas and a leading rm are dropped, parentheses mean negative; NULL if no number is left.

    Texts of digits, points and signs only, most of a statement, are cast as they are.
    """
    bare = F.translate(text, "0123456789.-", "") == ""
    plain = F.regexp_replace(F.trim(text), r"(?i)^\(?rm ?|,", "")
    number = F.regexp_replace(plain, r"[()]", "").try_cast(MONEY)
    read = F.when(F.trim(text).startswith("(") & F.trim(text).endswith(")"), -number).otherwise(number)
    return F.when(text.isNull(), F.lit(None)).when(bare, text.try_cast(MONEY)).otherwise(read).cast(MONEY)


def exact_money(value: Column) -> Column:
    """The value as whole cents; raises if it isn't."""
    return F.when(value.isNull() | (value == value.cast(MONEY)), value.cast(MONEY)).otherwise(F.raise_error(F.concat(F.lit("amount is no whole cent: "), value.cast("string"))))


def fits(text: Column, precision: int, scale: int) -> Column:
    """Is the text a number with at most ``scale`` decimals that a decimal of this precision holds?"""
    number = text.try_cast("decimal(38,10)")
    return F.coalesce((number == number.try_cast(f"decimal({precision},{scale})")), F.lit(False))


def checked_money(text: Column, precision: int = 12, scale: int = 2) -> Column:
    """The number; raises where it doesn't fit; blank is NULL."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    value = text.try_cast(f"decimal({precision},{scale})")
    return F.when(blank, F.lit(None)).when(fits(text, precision, scale), value).otherwise(F.raise_error(F.concat(F.lit("number doesn't fit: "), text)))


def money_text(text: Column) -> Column:
    """A number without trailing zeros, 0 as "0"; what is no number, blank or missing stays as it is."""
    number = F.trim(text).try_cast("decimal(38,6)")
    return F.when(number.isNull(), text).when(number == 0, F.lit("0")).otherwise(F.regexp_replace(number.cast("string"), r"\.?0+$", ""))


def present_money(text: Column) -> Column:
    """Lenient money, but NULL where the text is one of the marks of a missing value."""
    missing = F.lower(F.coalesce(F.trim(text), F.lit(""))).isin("", "n/a", "none", "null")
    return F.when(~missing, lenient_money(text))


DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")


def any_date(text: Column, formats: tuple[str, ...] = DATES) -> Column:
    """The date by the first format that fits; NULL if none does."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats))


def strict_date(text: Column) -> Column:
    """The date; blank and N/A are NULL, anything else that isn't one raises."""
    missing = F.lower(F.coalesce(F.trim(text), F.lit(""))).isin("", "n/a")
    return F.when(missing, F.lit(None)).otherwise(F.coalesce(any_date(text), F.raise_error(F.concat(F.lit("no date: "), text)).cast("date")))


def price_and_total(quantity: Column, price: Column, total: Column) -> Column:
    """(price, total) to the cent; the one that is missing or 0 follows from the other."""
    p, t = F.coalesce(price, F.lit(0)).cast(MONEY), F.coalesce(total, F.lit(0)).cast(MONEY)
    return F.struct(F.when((p == 0) & (t != 0), F.bround(t / quantity, 2)).otherwise(p).cast(MONEY).alias("price"), F.when((t == 0) & (p != 0), p * quantity).otherwise(t).cast(MONEY).alias("total"))


def market_money(text: Column) -> Column:
    """Dollar marks before digits become the shared prefix."""
    return F.regexp_replace(text, r"S?\$\s*(?=[0-9])", "RM")


def currency_text(value: Column, symbol: Column, missing: str = "N/A") -> Column:
    return F.coalesce(F.concat(symbol, F.lit(" "), F.format_number(value, 2)), F.lit(missing))

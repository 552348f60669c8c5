"""Context labels. User agents and URLs are first reduced to small codes, so that aggregates
over them keep fixed-width buffers and run as hash aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import HANDHELD_MARKS

HANDHELD, SOCIAL = 1, 2
CAMPAIGN, CART = 1, 2
N_CODES = 4


def _flag(condition: Column, bit: int) -> Column:
    return F.when(condition, F.lit(bit)).otherwise(F.lit(0))


def usable(text: Column) -> Column:
    """Lower-cased text, null when there is none."""
    return F.when(text != "", F.lower(text))


def user_agent_code(user_agent: Column) -> Column:
    text = F.lower(user_agent)
    handheld = reduce(lambda a, b: a | b, [text.contains(m) for m in HANDHELD_MARKS])
    return F.when(
        user_agent != "", _flag(handheld, HANDHELD) + _flag(text.contains("facebook"), SOCIAL)
    )


def url_code(url: Column) -> Column:
    text = F.lower(url)
    return F.when(
        url != "", _flag(text.contains("utm_source"), CAMPAIGN) + _flag(text.contains("/cart"), CART)
    )


def _has(code: Column, bit: int) -> Column:
    return F.coalesce(code.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def device(ua_code: Column) -> Column:
    """Desktop only when a user agent is known and bears no handheld mark."""
    return F.when(ua_code.isNotNull() & ~_has(ua_code, HANDHELD), "desktop").otherwise("mobile")


def source(ua_code: Column, url_code: Column) -> Column:
    return F.when(_has(url_code, CAMPAIGN) | _has(ua_code, SOCIAL), "ads").otherwise("direct")


def intent(url_code: Column) -> Column:
    return F.when(_has(url_code, CART), "checkout").otherwise("browse")

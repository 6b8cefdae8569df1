"""Scalar column functions: codes, boards, quarters, display text and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code prefixes of listed A-shares by market, and of the two growth boards.
A_SHARE_PREFIXES = {"SH": ("600", "601", "603", "605", "688", "689"), "SZ": ("000", "001", "002", "003", "300", "301", "302")}
STAR_PREFIXES, CHINEXT_PREFIXES = ("688", "689"), ("300", "301", "302")
EXCHANGES = {"SH": "XSHG", "SZ": "XSHE", "BJ": "XBSE"}


def canonical_code(code: Column) -> Column:
    """'sh.600000' as 'SH.600000'; NULL unless it is a market of SH or SZ, a dot and six digits."""
    c = F.upper(F.trim(code))
    return F.when(c.rlike(r"^(SH|SZ)\.[0-9]{6}$"), c)


def exchange_of(code: Column) -> Column:
    market = F.substring(F.upper(code), 1, 2)
    out = F.lit(None).cast("string")
    for k, v in EXCHANGES.items():
        out = F.when(market == k, F.lit(v)).otherwise(out)
    return out


def is_a_share(code: Column) -> Column:
    c = F.upper(code)
    hit = F.lit(False)
    for market, prefixes in A_SHARE_PREFIXES.items():
        hit = hit | ((F.substring(c, 1, 3) == f"{market}.") & F.substring(c, 4, 3).isin(*prefixes))
    return F.coalesce(hit, F.lit(False))


def board(code: Column) -> Column:
    market, prefix = F.substring(code, 1, 3), F.substring(code, 4, 3)
    return F.when((market == "SH.") & prefix.isin(*STAR_PREFIXES), "star").when((market == "SZ.") & prefix.isin(*CHINEXT_PREFIXES), "chinext").otherwise("main")


def quarter_ordinal(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def local_date(at: Column, zone: str = "Asia/Shanghai") -> Column:
    """The trading date of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def canonical_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def partition_value(c: Column) -> Column:
    """URL-quoted text for a path."""
    return F.url_encode(c)


def signed_percent(c: Column, digits: int = 1) -> Column:
    """'+1.5%', half up; NULL is 'unavailable'."""
    return F.when(c.isNull(), "unavailable").otherwise(F.concat(F.when(c >= 0, "+").otherwise("-"), F.format_string(f"%.{digits}f", F.abs(c) * 100), F.lit("%")))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def is_symbol(c: Column) -> Column:
    """Six digits."""
    return F.coalesce(c.rlike("^[0-9]{6}$"), F.lit(False))


def bar_start(c: Column, scale: float) -> Column:
    """Where a bar of a centred scale begins, in percent of the width."""
    width = F.abs(c) / scale * 45
    return F.when(c < 0, 50 - width).otherwise(F.lit(50.0))


def bar_direction(c: Column) -> Column:
    return F.when(c > 0, "positive").when(c < 0, "negative").when(c == 0, "flat")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by '|'; NULL parts are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)

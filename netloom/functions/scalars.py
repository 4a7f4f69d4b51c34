"""Scalar rules: speeds, flags, saturation and reason letters."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from netloom.functions.times import col
from netloom.schemas import SPEED_EDGES_KBIT


def bit(c, mask: int) -> Column:
    """Whether any bit of the mask is set."""
    return col(c).bitwiseAND(F.lit(mask)) != 0


def saturate(c, bits: int) -> Column:
    """Cut a count to the greatest number of `bits` bits."""
    return F.least(col(c), F.lit(2**bits - 1).cast("long"))


def rate(size, window_us) -> Column:
    """Bytes per second of bytes in a window given in microseconds."""
    return col(size) * F.lit(1e6) / col(window_us)


def mbits(size, window_us) -> Column:
    """Megabits per second of bytes in a window given in microseconds."""
    return rate(size, window_us) * 8 / 1e6


def kbit_to_bytes(kbit) -> Column:
    return F.floor(col(kbit) * 1000 / 8).cast("long")


def bytes_to_kbit(size) -> Column:
    return F.floor(col(size) * 8 / 1000).cast("long")


def _stretches(edges):
    """Stretches of equally wide buckets: (last edge, edge before the first bucket, width, position of the first)."""
    steps = list(enumerate(zip([0, *edges], edges)))
    for width, group in groupby(steps, lambda step: step[1][1] - step[1][0]):
        buckets = list(group)
        first, (before, _) = buckets[0]
        yield buckets[-1][1][1], before, width, first


SPEED_STRETCHES = tuple(_stretches(SPEED_EDGES_KBIT))


def speed_bucket(bytes_per_second: Column) -> Column:
    """Position 0-39 of a speed; an edge belongs to the lower bucket.

    No traffic is in the first bucket, speeds above the last edge in none.
    """
    in_bytes = lambda kbit: kbit * 1000 // 8
    # Spark's ceil keeps this to arithmetic: no lookup over the 40 edges.
    result = F.when(bytes_per_second <= 0, 0)
    for last, before, width, first in SPEED_STRETCHES:
        steps = F.ceil((bytes_per_second - in_bytes(before)) / in_bytes(width))
        result = result.when(bytes_per_second <= in_bytes(last), steps + first - 1)
    return result.cast("int")


def icmp_reason(family, code) -> Column:
    """Reason letter of an ICMP unreachable code; NULL when it is no refusal.

    N network, H host, P port, A administrative, O other.
    """
    f, c = col(family), col(code)
    # Codes by family.
    v4 = (
        F.when(c.isin(0, 6), "N").when(c.isin(1, 7), "H").when(c == 3, "P")
        .when(c.isin(9, 10, 13), "A").when(c == 4, None).otherwise("O")
    )
    v6 = F.when(c == 0, "N").when(c == 1, "A").when(c == 3, "H").when(c == 4, "P").otherwise("O")
    return F.when(f == 4, v4).otherwise(v6)


# Name patterns of networks with their owners, first match wins.
NETWORK_OWNERS = (
    (r"^AKAMAI-(\d+|PA|ARIN-\d+)$", "Akamai"),
    (r"^AIBV$", "Akamai"),
    (r"^AKAMAI$", "Akamai"),
    (r"^EU-AKAMAI-\d+$", "Akamai"),
    (r"^TWITTER-NETWORK$", "Twitter"),
    (r"^IE-TWITTER-INTL-", "Twitter"),
    (r"^GOOGLE$", "Google"),
    (r"^MICROSOFT$", "Microsoft"),
    (r"^MSFT-GFS$", "Microsoft"),
    (r"^MSFT$", "Microsoft"),
    (r"^MICROSOFT-1BLK", "Microsoft"),
    (r"^EBAY-\d+$", "Ebay"),
    (r"^SEZNAM-CZ$", "Seznam"),
    (r"^FIO-BANKA-NET$", "FIO"),
    (r"^(ATL1|LAX1|SJC1|SEA1)$", "Facebook"),
    (r"^FACEBOOK-INC$", "Facebook"),
    (r"^TFBNET\d+$", "Facebook"),
    (r"^IAD1$", "Facebook"),
    (r"^THEFA-\d+$", "Facebook"),
    (r"^IAD2$", "Facebook"),
    (r"^HKG\d+$", "Facebook"),
    (r"^PEO\d+$", "Facebook"),
)


def owner_class(network: Column, owners=NETWORK_OWNERS) -> Column:
    """Owner of a network name by the first pattern found in it; NULL for others."""
    result = F.lit(None).cast("string")
    for owner, rows in groupby(reversed(owners), lambda row: row[1]):
        pattern = "|".join(text for text, _ in reversed(list(rows)))
        result = F.when(network.rlike(pattern), owner).otherwise(result)
    return result


def hex_text(c) -> Column:
    """Bytes as lower-case hex."""
    return F.lower(F.hex(col(c)))


def hex_bytes(c) -> Column:
    """Inverse of `hex_text`."""
    return F.unhex(col(c))


def endpoint(side: str, src="src", dst="dst", direction="direction") -> Column:
    """Local or remote end of a packet; NULL when its direction is unknown."""
    d = col(direction)
    inner, outer = (dst, src) if side == "local" else (src, dst)
    return F.when(d == "in", col(inner)).when(d == "out", col(outer))

"""Addresses as column expressions: parsing, text, networks and classes.

Addresses are text in tables; `ip_bin` gives 4 or 16 bytes, NULL for text that
is not an address. Everything stays in built-in expressions, so filters and
join keys on addresses run inside the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.times import col, let

# The forms of addresses.
V4_FORM = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
V6_FORM = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"
MAPPED_PREFIX = "00000000000000000000FFFF"


def ip_family(c) -> Column:
    """6 for text with a colon, else 4."""
    return F.when(F.contains(col(c), F.lit(":")), 6).otherwise(4)


def v4_num(c) -> Column:
    """IPv4 text as a number; NULL for other text."""
    parts = F.split(col(c), r"\.")
    byte = lambda i: F.get(parts, F.lit(i)).cast("long")
    value = byte(0) * 16777216 + byte(1) * 65536 + byte(2) * 256 + byte(3)
    return F.when(col(c).rlike(V4_FORM), value)


def v4_text(num) -> Column:
    """Number as IPv4 text."""
    n = col(num)
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _v6_hex(c: Column) -> Column:
    """IPv6 text as 32 hex digits; NULL for other text."""
    empty = F.array().cast("array<string>")

    def undotted(c: Column) -> Column:
        """A dotted tail as two groups."""
        tail = F.regexp_extract(c, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
        tail_hex = F.lpad(F.hex(v4_num(tail)), 8, "0")
        head = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
        groups = F.concat(F.substring(tail_hex, 1, 4), F.lit(":"), F.substring(tail_hex, 5, 4))
        return F.when(F.contains(c, F.lit(".")), F.concat(head, groups)).otherwise(c)

    def groups_of(sides: Column) -> Column:
        """Groups of both sides of "::", with the zero groups it stands for."""
        side = lambda i: F.when(F.get(sides, F.lit(i)) == "", empty).otherwise(F.split(F.get(sides, F.lit(i)), ":", -1))
        filled = let(
            F.struct(side(0).alias("l"), side(1).alias("r")),
            lambda s: F.concat(
                s["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(1), 8 - F.size(s["l"]) - F.size(s["r"]))), s["r"]
            ),
        )
        return F.when(F.size(sides) == 2, filled).when(F.size(sides) == 1, side(0))

    def digits(groups: Column) -> Column:
        sound = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
        return F.when(sound, F.upper(F.concat_ws("", F.transform(groups, lambda g: F.lpad(g, 4, "0")))))

    sides = let(undotted(c), lambda plain: F.split(plain, "::", -1))
    return let(let(sides, groups_of), digits)


def ip_bin(c) -> Column:
    """Address text as 4 or 16 bytes; NULL when it is no address."""
    c = col(c)
    v6 = F.contains(c, F.lit(":"))
    return F.when(v6, F.unhex(_v6_hex(c))).otherwise(F.unhex(F.lpad(F.hex(v4_num(c)), 8, "0")))


def _byte_text(hexed: Column, start: int) -> Column:
    return F.conv(F.substring(hexed, start, 2), 16, 10)


def _v6_text(hexed: Column) -> Column:
    """32 hex digits as canonical text."""
    group = lambda i: F.lower(F.regexp_replace(F.substring(hexed, 1 + 4 * i, 4), "^0{1,3}", ""))

    def shortened(groups: Column) -> Column:
        # The longest run of zero groups becomes "::", the leftmost among equals.
        short = groups
        for run in range(2, 9):
            zeros = r"(?:^|:)0(?::0){%d}(?:$|:)" % (run - 1)
            short = F.when(
                groups.rlike(zeros), F.regexp_replace(groups, f"^(.*?){zeros}(.*)$", "$1::$2")
            ).otherwise(short)
        return short

    return let(F.concat_ws(":", *[group(i) for i in range(8)]), shortened)


def ip_text(b) -> Column:
    """4 or 16 bytes as canonical text."""

    def text(hexed: Column) -> Column:
        dotted = lambda at: F.concat_ws(".", *[_byte_text(hexed, at + 2 * i) for i in range(4)])
        mapped = F.substring(hexed, 1, 24) == MAPPED_PREFIX
        return (
            F.when(F.length(hexed) == 8, dotted(1))
            .when((F.length(hexed) == 32) & mapped, F.concat(F.lit("::ffff:"), dotted(25)))
            .when(F.length(hexed) == 32, _v6_text(hexed))
        )

    return let(F.hex(col(b)), text)


def ip_canon(c) -> Column:
    """Canonical text of an address in any notation."""
    return ip_text(ip_bin(c))


def unmap_v4(b) -> Column:
    """The inner 4 bytes of an IPv4 address mapped into IPv6."""
    b = col(b)
    mapped = (F.length(b) == 16) & (F.substring(F.hex(b), 1, 24) == MAPPED_PREFIX)
    return F.when(mapped, F.substring(b, 13, 4)).otherwise(b)


def halves(c) -> Column:
    """Address text as two longs, the IPv4 number in the top 32 bits.

    A prefix of n bits then means the same masking in both families.
    """
    c = col(c)

    def of_hex(hexed: Column) -> Column:
        part = lambda at: F.conv(F.substring(hexed, at, 16), 16, -10).cast("long")
        return F.struct(part(1).alias("hi"), part(17).alias("lo"))

    # Text that is no address has a NULL `hi`.
    v4 = F.struct(F.shiftleft(v4_num(c), 32).alias("hi"), F.lit(0).cast("long").alias("lo"))
    return F.when(F.contains(c, F.lit(":")), let(_v6_hex(c), of_hex)).otherwise(v4)


def mask_halves(hi: Column, lo: Column, bits: Column) -> tuple[Column, Column]:
    """Keep the first `bits` bits of a pair of longs."""
    cut = lambda x, n: F.call_function("shiftleft", F.call_function("shiftright", x, n), n)
    zero = F.lit(0).cast("long")
    high = F.when(bits <= 0, zero).when(bits >= 64, hi).otherwise(cut(hi, (64 - bits).cast("int")))
    low = F.when(bits <= 64, zero).when(bits >= 128, lo).otherwise(cut(lo, (128 - bits).cast("int")))
    return high, low


def ip_net(c, bits: int) -> Column:
    """Network address (text) of the first `bits` bits of an address."""
    c = col(c)

    def v6_text(pair: Column) -> Column:
        hi, lo = mask_halves(pair["hi"], pair["lo"], F.lit(bits))
        return ip_text(F.unhex(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0"))))

    def v4_net(pair: Column) -> Column:
        hi, _ = mask_halves(pair["hi"], pair["lo"], F.lit(bits))
        return F.when(hi.isNotNull(), v4_text(F.shiftrightunsigned(hi, 32)))

    return F.when(F.contains(c, F.lit(":")), let(halves(c), v6_text)).otherwise(let(halves(c), v4_net))


def in_cidr(c, network: str, prefix: int) -> Column:
    """Whether an address lies in a range of its own family; prefix 0 never matches."""
    c = col(c)
    if prefix <= 0:
        return F.lit(False)
    if ":" not in network:
        return F.coalesce(_v4_in(v4_num(c), network, prefix), F.lit(False))

    def same(both: Column) -> Column:
        hi, lo = mask_halves(both["a"]["hi"], both["a"]["lo"], F.lit(prefix))
        want_hi, want_lo = mask_halves(both["n"]["hi"], both["n"]["lo"], F.lit(prefix))
        return (hi == want_hi) & (lo == want_lo)

    inside = let(F.struct(halves(c).alias("a"), halves(F.lit(network)).alias("n")), same)
    return F.coalesce(F.contains(c, F.lit(":")) & inside, F.lit(False))


# Ranges that are not public.
NOT_PUBLIC_V4 = (
    ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("127.0.0.0", 8),
    ("255.255.255.255", 32), ("224.0.0.0", 4), ("0.0.0.0", 32),
    ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("169.254.0.0", 16),
)
LEGACY_V4 = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4))
# Text forms of ::, ::1 and ff00::/8, and of the older f000::/8.
NOT_PUBLIC_V6 = r"^[0:]+$|^[0:]*:0{0,3}1$|^[0:]*:0\.0\.0\.[01]$|^[fF][fF][0-9a-fA-F]{2}:"
LEGACY_V6 = r"^[fF]0[0-9a-fA-F]{2}:"
# Text prefixes of private and link-local addresses.
PRIVATE_TEXT = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|[fF][eEdD]..:)"


def _v4_in(num: Column, network: str, prefix: int) -> Column:
    """Range test on the number: two comparisons."""
    parts = [int(p) for p in network.split(".")]
    low = reduce(lambda a, p: a * 256 + p, parts, 0)
    return num.between(low, low + 2 ** (32 - prefix) - 1)


def p_public_ip(c, legacy: bool = False) -> Column:
    """Public addresses only; `legacy` drops the shorter, older list of ranges."""
    c = col(c)
    ranges = LEGACY_V4 if legacy else NOT_PUBLIC_V4
    in_any = let(v4_num(c), lambda num: reduce(lambda a, b: a | b, [_v4_in(num, n, p) for n, p in ranges]))
    v6 = c.rlike(V6_FORM) | c.rlike(r"^[0-9A-Fa-f:]*:\d+\.\d+\.\d+\.\d+$")
    bad_v6 = c.rlike(LEGACY_V6 if legacy else NOT_PUBLIC_V6)
    return F.when(F.contains(c, F.lit(":")), v6 & ~bad_v6).otherwise(F.coalesce(~in_any, F.lit(False)))


def p_private_text(c) -> Column:
    """Private or link-local, judged by the text alone."""
    return col(c).rlike(PRIVATE_TEXT)


def p_unicast_mac(c) -> Column:
    """MAC text whose first byte is even."""
    return F.conv(F.substring(col(c), 1, 2), 16, 10).cast("int") % 2 == 0


def mac_text(b) -> Column:
    """6 bytes as colon-separated lower-case hex."""
    return F.regexp_replace(F.lower(F.hex(col(b))), r"(..)(?=.)", "$1:")


def addr_port(address, port) -> Column:
    """`ip:port`, with IPv6 in brackets; the bare address when there is no port."""
    a, p = col(address), col(port)
    host = F.when(F.contains(a, F.lit(":")), F.concat(F.lit("["), a, F.lit("]"))).otherwise(a)
    return F.when(p.isNull(), a).otherwise(F.concat(host, F.lit(":"), p.cast("string")))


def parse_addr_port(c) -> Column:
    """Inverse of `addr_port`."""
    c = col(c)
    form = r"^(?:\[([0-9A-Fa-f:.]+)\]|([0-9.]+)):(\d+)$"
    inner = F.concat(F.regexp_extract(c, form, 1), F.regexp_extract(c, form, 2))
    return F.struct(
        F.when(c.rlike(form), inner).otherwise(c).alias("address"),
        F.nullif(F.regexp_extract(c, form, 3), F.lit("")).try_cast("int").alias("port"),
    )


def parse_set_item(c) -> Column:
    """Item of a firewall set: `ip[/range][,proto:port]`; a full-length range is none.

    All fields are NULL if the text has another form, or a number is too large.
    """
    c = col(c)
    form = r"^([^,/]+)(?:/(\d+))?(?:,(udp|tcp):(\d+))?$"
    address = F.regexp_extract(c, form, 1)
    number = lambda i: F.nullif(F.regexp_extract(c, form, i), F.lit(""))
    bits, port = number(2).try_cast("int"), number(4).try_cast("int")
    whole = F.when(F.contains(address, F.lit(":")), 128).otherwise(32)
    readable = c.rlike(form) & (number(2).isNull() | (bits <= whole)) & (number(4).isNull() | (port <= 65535))
    return F.struct(
        F.when(readable, address).alias("ip"),
        F.when(readable, number(3)).alias("proto"),
        F.when(readable, port).alias("port"),
        F.when(readable, F.nullif(bits, whole)).alias("prefix"),
    )


def format_set_entry(kind, address, port=None, prefix=None) -> Column:
    """Entry text by set type: `ip`, `net` (address/prefix) or `ip,port` (address,port)."""
    k, a = col(kind), col(address)
    return (
        F.when(k == "ip", a)
        .when(k == "net", F.concat(a, F.lit("/"), col(prefix).cast("string")))
        .when(k == "ip,port", F.concat(a, F.lit(","), col(port).cast("string")))
    )


def cidr_join(df: DataFrame, address: str, prefixes: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the prefixes (columns `network`, `prefix`) that hold their address.

    Each address is masked once per prefix length in use (at most 32 + 128
    lengths exist) and meets the prefixes by equality; no range comparison and
    no nested loop. The lengths arrive as one aggregated row per family. Only
    distinct addresses are masked, so the rows themselves never multiply.
    """
    ranges = prefixes.select(
        "network", "prefix", ip_family("network").alias("_family"), halves("network").alias("_p")
    ).where((F.col("prefix") > 0) & F.col("_p.hi").isNotNull())
    hi, lo = mask_halves(F.col("_p.hi"), F.col("_p.lo"), F.col("prefix"))
    ranges = ranges.select("network", "prefix", "_family", hi.alias("_hi"), lo.alias("_lo")).distinct()
    lengths = ranges.groupBy("_family").agg(F.collect_set("prefix").alias("_lengths"))
    seen = (
        df.select(F.col(address).alias("_address"))
        .distinct()
        .select("_address", ip_family("_address").alias("_family"), halves("_address").alias("_a"))
        .join(F.broadcast(lengths), "_family")  # two rows
        .select("_address", "_family", "_a", F.explode("_lengths").alias("_bits"))
    )
    hi, lo = mask_halves(F.col("_a.hi"), F.col("_a.lo"), F.col("_bits"))
    masked = seen.select("_address", "_family", F.col("_bits").alias("prefix"), hi.alias("_hi"), lo.alias("_lo"))
    hits = masked.join(ranges, ["_family", "prefix", "_hi", "_lo"]).select("_address", "network", "prefix")
    if how in ("left_semi", "left_anti"):
        hits = hits.select("_address").distinct()
    out = df.join(hits, df[address] == hits["_address"], how)
    return out if how in ("left_semi", "left_anti") else out.drop("_address")


def drop_subnets(df: DataFrame, address: str, subnets: DataFrame) -> DataFrame:
    """Rows whose address lies in none of the subnets."""
    return cidr_join(df, address, subnets, "left_anti")

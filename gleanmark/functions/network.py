"""Addresses, media types and size limits of fetched files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by kind, and the most bytes of a file.
MEDIA_TYPES = {
    "image": ("image/jpeg", "image/png", "image/webp", "image/avif", "image/gif", "image/svg+xml"),
    "video": ("video/mp4", "video/webm"),
    "audio": ("audio/mp4", "audio/mpeg", "audio/aac", "audio/ogg", "audio/wav", "audio/webm", "audio/flac"),
}
MIB = 1 << 20
MOST_BYTES = {"image": 25 * MIB, "video": 250 * MIB, "audio": 250 * MIB}


def is_private_address(address: Column) -> Column:
    """Whether an IP address isn't public: private, loopback, link-local, shared, benchmark, multicast and reserved
    ranges of IPv4, and IPv6 outside 2000::/3. Text that is no address counts as private."""
    octets = F.transform(F.split(address, "\\."), lambda o: o.try_cast("int"))
    a, b = (F.get(octets, F.lit(k)) for k in range(2))
    is_v4 = address.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$") & F.forall(octets, lambda o: o <= 255)
    private = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & b.isin(0, 168))
        | ((a == 198) & b.isin(18, 19))
    )
    return F.when(is_v4, private).when(address.contains(":"), ~F.lower(address).rlike("^[23][0-9a-f]{3}:")).otherwise(True)


def media_kind(media_type: Column) -> Column:
    """``image``, ``video`` or ``audio`` of an allowed media type; null for others. Parameters don't count."""
    bare = F.lower(F.trim(F.split(media_type, ";")[0]))
    out = F
    for kind, types in MEDIA_TYPES.items():
        out = out.when(bare.isin(*types), kind)
    return out.otherwise(F.lit(None).cast("string"))


def within_limit(kind: Column, size: Column) -> Column:
    """Whether a file of ``size`` bytes may be kept."""
    out = F
    for name, most in MOST_BYTES.items():
        out = out.when(kind == name, size <= most)
    return out.otherwise(False)


def desktop_agent(value: Column) -> Column:
    """A browser's name without the mark of a hidden one; null where it names no version or holds a line break."""
    return F.when(value.rlike("Chrome/[\\d.]+") & ~value.rlike("[\\r\\n]"), F.replace(value, F.lit("HeadlessChrome/"), F.lit("Chrome/")))


def proxy_server(value: Column) -> Column:
    """``struct<server, username, password>`` of a proxy address; null for other schemes than http, https and socks5."""
    part = lambda k: F.regexp_extract(value, "^(?i)(https?|socks5)://(?:([^:@/]*)(?::([^@/]*))?@)?([^/?#@]+)", k)
    secret = lambda k: F.when(part(2) != "", F.try_url_decode(part(k)))
    return F.when(part(4) != "", F.struct(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(4))).alias("server"), secret(2).alias("username"), secret(3).alias("password")))

"""Scalar functions of the log: hashes, cursor texts, checks and formats, all as Columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF

#: Alphabetic codes of currencies, funds and metals (ISO 4217, fixed values).
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF "
    "CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL "
    "HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD "
    "MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF "
    "SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU "
    "UYW UZS VED VES VND VUV WST XAF XAG XAU XBA XBB XBC XBD XCD XDR XOF XPD XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWG"
).split()

# Forms of ids, times and names.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
EVENT_TYPE_NAME = r"^[a-zA-Z][-0-9a-zA-Z_]*(\.[0-9a-zA-Z][-0-9a-zA-Z_]*)*$"


def string_hash(text: Column) -> Column:
    """The 32-bit string hash 31 * h + code unit, as a signed int. Characters above U+FFFF count as their two surrogates."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, u: (h * 31 + u).bitwiseAND(_MASK)
    both = lambda h, u: step(step(h, F.lit(0xD800) + F.shiftright(u - 0x10000, 10)), F.lit(0xDC00) + (u - 0x10000) % 1024)
    folded = F.aggregate(F.when(text == "", F.array().cast("array<bigint>")).otherwise(points), F.lit(0).cast("long"), lambda h, u: F.when(u > 0xFFFF, both(h, u)).otherwise(step(h, u)))
    return F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded).cast("int")


def partition_of(keys: Sequence[Column], count: int, override: Sequence[int] | None = None) -> Column:
    """The partition of a record by its key fields: the sum of their hashes (32 bits, wrapping) modulo ``count``.

    ``override`` renames the partitions: the k-th entry is the partition that index k goes to.
    """
    if not keys:
        raise ValueError("hash partitioning needs key fields")
    total = string_hash(keys[0]).cast("long")
    for key in keys[1:]:
        total = total + string_hash(key)
    wrapped = total.bitwiseAND(_MASK)
    signed = F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)
    index = F.abs(signed % count).cast("int")
    if override is None:
        return index
    if sorted(override) != list(range(count)):
        raise ValueError("override must name each partition once")
    return F.element_at(F.array(*[F.lit(p) for p in override]), index + 1)


def pad_left(text: Column, width: int, fill: str = "0") -> Column:
    """``text`` padded to ``width``; longer texts stay whole."""
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def offset_text(offset: Column) -> Column:
    """An offset as text: 18 digits, negative ones as they are."""
    return F.when(offset < 0, offset.cast("string")).otherwise(pad_left(offset.cast("string"), 18))


def cursor_text(order: Column, offset: Column) -> Column:
    """A cursor's external form: version, timeline order in hexadecimal, offset."""
    return F.concat(F.lit("001-"), pad_left(F.lower(F.hex(order)), 4), F.lit("-"), offset_text(offset))


def cursor_order(text: Column) -> Column:
    """The timeline order of an external cursor, or null."""
    return F.when(is_cursor(text), F.conv(F.split(text, "-").getItem(1), 16, 10).cast("int"))


def cursor_offset(text: Column) -> Column:
    """The offset of an external cursor, or null."""
    return F.when(is_cursor(text), F.regexp_extract(text, r"^001-[0-9a-f]{4}-(-?[0-9]+)$", 1).cast("long"))


def is_cursor(text: Column) -> Column:
    """Whether a text is a cursor with version, order and offset."""
    return F.coalesce(text.rlike(r"^001-[0-9a-f]{4}-([0-9]{18}|-1)$"), F.lit(False))


def is_uuid(text: Column) -> Column:
    """Whether a text is a UUID."""
    return F.coalesce(text.rlike(UUID), F.lit(False))


def is_date_time(text: Column) -> Column:
    """Whether a text is a date-time with an offset (RFC 3339)."""
    return F.coalesce(text.rlike(DATE_TIME) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def is_currency(text: Column) -> Column:
    """Whether a text is a currency code."""
    return F.coalesce(text.isin(CURRENCIES), F.lit(False))


def is_event_type_name(text: Column) -> Column:
    """Whether a text can name an event type."""
    return F.coalesce(text.rlike(EVENT_TYPE_NAME) & (F.length(text) <= 255), F.lit(False))


def salted_hash(text: Column, salt: str) -> Column:
    """SHA-256 of salt and text, in hexadecimal."""
    return F.sha2(F.concat(F.lit(salt), text).cast("binary"), 256)


def fields_hash(*fields: Column) -> Column:
    """MD5 of the fields, one after the other."""
    return F.md5(F.concat_ws("", *fields).cast("binary"))


def json_pointer(path: Column) -> Column:
    """A dotted path as a JSON pointer."""
    return F.concat(F.lit("/"), F.replace(path, F.lit("."), F.lit("/")))


def version_parts(text: Column) -> Column:
    """major, minor and patch of a semantic version, or null."""
    part = lambda k: F.split(text, r"\.").getItem(k).cast("int")
    return F.when(text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch")))


def attribute(text: Column) -> Column:
    """An authorization attribute ``type:value`` as a struct, or null."""
    parts = F.split(text, ":", 2)
    return F.when(text.rlike(r"^[^:]+:.+$"), F.struct(parts.getItem(0).alias("data_type"), parts.getItem(1).alias("value")))


def json_path(text: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text. Quoted segments may hold dots: ``a.'b.c'``."""
    segments, now, quoted, escaped = [], "", False, False
    for ch in path:
        if escaped:
            now, escaped = now + ch, False
        elif ch == "\\":
            escaped = True
        elif ch == "'":
            quoted = not quoted
        elif ch == "." and not quoted:
            segments.append(now)
            now = ""
        else:
            now += ch
    if quoted or escaped:
        raise ValueError(f"not a path: {path}")
    segments.append(now)
    return F.try_variant_get(F.try_parse_json(text), "$" + "".join(f'["{s}"]' for s in segments), "string")


def size_bucket(size: Column) -> Column:
    """The bucket of a batch's bytes for service objectives."""
    return F.when(size < 5000, "<5K").when(size > 50000, ">50K").otherwise("5K-50K")


def lag_seconds(since: Column, as_of: Column) -> Column:
    """Whole seconds from a time to another."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000).cast("long")


def order_text(order: Column) -> Column:
    """A timeline's order as in cursors: hexadecimal, four digits at least."""
    return pad_left(F.lower(F.hex(order)), 4)


def order_of(text: Column) -> Column:
    """The order that a hexadecimal text stands for."""
    return F.conv(text, 16, 10).cast("long")


def compact_json(text: Column) -> Column:
    """A JSON text without the white space outside its strings."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|[ \t\n\r]+', "$1")

"""Scalar functions as Column expressions. All run inside Catalyst; none calls Python for a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of each unit, decimal and binary.
UNITS = {
    "": 1, "b": 1,
    "kb": 1000, "mb": 1000**2, "gb": 1000**3, "tb": 1000**4, "pb": 1000**5,
    "kib": 1024, "mib": 1024**2, "gib": 1024**3, "tib": 1024**4, "pib": 1024**5,
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_bytes(c: Column | str, strict: bool = False) -> Column:
    """Bytes (double) of a size such as ``1200 GiB``; no number counts as 1, no unit as bytes, letters in either case.

    Text that is no size gives null, or fails the query with ``strict``. Null stays null.
    """
    text = F.regexp_replace(F.lower(_col(c)), " ", "")
    number = F.regexp_extract(text, r"^([0-9.+-]*(?:e[+-]?[0-9]+)?)[a-z]*$", 1)
    unit = F.regexp_extract(text, r"([a-z]*)$", 1)
    unit = F.when(number.contains("e"), F.regexp_extract(text, r"e[+-]?[0-9]+([a-z]*)$", 1)).otherwise(unit)
    units = F.create_map(*(x for k, v in UNITS.items() for x in (F.lit(k), F.lit(float(v)))))
    factor = F.try_element_at(units, unit)
    value = F.when(number == "", F.when(text.rlike("^[a-z]*$"), F.lit(1.0))).otherwise(F.expr("1").cast("double") * number.try_cast("double")) * factor
    if not strict:
        return value
    return F.when(_col(c).isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit("not a size in bytes: "), _col(c)))).otherwise(value)


def disk_capacity(c: Column | str) -> Column:
    """Whole GiB of a disk size, rounded up; ``auto`` is -1."""
    return F.when(_col(c) == "auto", F.lit(-1).cast("long")).otherwise(F.ceil(parse_bytes(c) / F.lit(float(2**30))))


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_col(c).cast("binary"), 256)


def arn_to_name(c: Column | str) -> Column:
    """The bucket in an ARN: its last field without ``/*``, ``/`` or ``*`` at the end."""
    return F.regexp_replace(F.element_at(F.split(_col(c), ":"), -1), r"(/\*|[/*])$", "")


def name_to_arn(c: Column | str) -> Column:
    return F.concat(F.lit("arn:aws:s3:::"), _col(c))


def endpoint(c: Column | str) -> Column:
    return F.translate(_col(c), "_", "-")


def parse_time(c: Column | str, strict: bool = False) -> Column:
    """A timestamp without zone from ISO text in UTC; the empty string is null. Other text gives null, or fails with ``strict``."""
    text = F.nullif(_col(c), F.lit(""))
    return text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")


def local_time(c: Column | str, zone: str) -> Column:
    """The wall clock in ``zone`` for a UTC timestamp without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(c))


def basename(c: Column | str) -> Column:
    return F.element_at(F.split(_col(c), "/"), -1)


def basenames(c: Column | str) -> Column:
    return F.transform(_col(c), basename)


def strip_file_scheme(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("file://"), F.lit(""))


def split_object_url(c: Column | str) -> Column:
    """Struct (bucket, key) of ``s3://bucket/key``; key is null without a slash."""
    parts = F.split(F.regexp_replace(_col(c), "^s3://", ""), "/", 2)
    return F.struct(F.get(parts, 0).alias("bucket"), F.get(parts, 1).alias("key"))


def encode_value(c: Column | str) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(_col(c).cast("binary")), "[\r\n]", "")


def decode_value(c: Column | str) -> Column:
    return F.unbase64(_col(c))


def default(c: Column | str, value) -> Column:
    return F.coalesce(_col(c), F.lit(value))


def first_given(*cs: Column | str) -> Column:
    """Precedence: argument, then environment, then file."""
    return F.coalesce(*map(_col, cs))


def backoff(i: Column | str, first: int = 5, most: int = 80) -> Column:
    """Seconds to wait before attempt ``i``: doubling from ``first`` to ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(first)) * F.pow(F.lit(2.0), _col(i).cast("double")))


def kernel(x: Column | str) -> Column:
    """(x + 1) squared."""
    return (_col(x) + 1) * (_col(x) + 1)


def all_of(predicates: dict[str, object]) -> Column:
    """Conjunction of equalities; a list means membership, None leaves the predicate out, nothing given means all rows."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(k) == v for k, v in predicates.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))

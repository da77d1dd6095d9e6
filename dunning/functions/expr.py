"""Column-expression helpers. Everything here is a built-in JVM expression
(whole-stage codegen), so no Python runs per row."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash8(x) -> Column:
    """First 8 hex digits of SHA-256 of the text, as an unsigned 32-bit integer."""
    return F.conv(F.substring(F.sha2(_c(x).cast("string"), 256), 1, 8), 16, 10).cast("long")


def hex_slice_int(hex_col, part: int) -> Column:
    """The ``part``-th 8-hex-digit slice (0-based) of a SHA-256 hex column as an
    unsigned 32-bit integer: several independent buckets from ONE hash."""
    return F.conv(F.substring(_c(hex_col), part * 8 + 1, 8), 16, 10).cast("long")


def salted_hash8(salt: str, x) -> Column:
    return hash8(F.concat(F.lit(salt), _c(x).cast("string")))


def hash_fraction(x, buckets: int = 100) -> Column:
    """Stable bucket in [0, 1): (first 8 hex digits of SHA-256) mod buckets / buckets."""
    return F.pmod(hash8(x), F.lit(buckets)) / F.lit(float(buckets))


def to_minor_units(amount) -> Column:
    """Major -> minor currency units (paise) as long, like Python's
    int(round(a * 100)): nearest integer of the binary value, ties to even."""
    return F.rint(_c(amount).cast("double") * 100).cast("long")


def hmac_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner/outer HMAC-SHA-256 key blocks, computed once on the driver."""
    key = secret.encode("utf-8")
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(secret: str, body) -> Column:
    """HMAC-SHA-256(secret, body) as lower-case hex, built from sha2 + unhex."""
    ipad, opad = hmac_pads(secret)
    inner = F.sha2(F.concat(F.unhex(F.lit(ipad.hex())), _c(body).cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(opad.hex())), F.unhex(inner)), 256)


def nan_to_null(x) -> Column:
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def ts_text(x) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd HH:mm:ss")


def dec2_text(x) -> Column:
    """Decimal text with exactly two places (no float formatting on either engine)."""
    return _c(x).cast("decimal(38,2)").cast("string")


def fixed_text(x, places: int) -> Column:
    """Like Python's '%.Nf': the exact binary value rounded half-even, no
    grouping separators (format_number rounds the binary value; T3/T4)."""
    return F.regexp_replace(F.format_number(_c(x).cast("double"), places), ",", "")


def round2_text(x) -> Column:
    """A fraction as text with two places ('0.28' for 0.285, like Python)."""
    return fixed_text(x, 2)


def fmt_percent(x) -> Column:
    """Confidence as percent text: values <= 1 are fractions; non-numbers -> fallback."""
    v = _c(x).cast("string").try_cast("double")
    pct = F.when(v <= 1, v * 100).otherwise(v)
    return F.coalesce(
        F.concat(fixed_text(pct, 1), F.lit("%")),
        F.lit("not available"))


def fmt_inr(x) -> Column:
    """Money text with Indian digit grouping: 290647.66 -> '₹2,90,647.66'."""
    d = _c(x).cast("decimal(38,2)")
    txt = F.abs(d).cast("string")
    ip = F.substring_index(txt, ".", 1)
    fp = F.substring_index(txt, ".", -1)
    n = F.length(ip)
    tail = F.when(n > 3, ip.substr(n - 2, F.lit(3))).otherwise(ip)
    head = F.when(n > 3, ip.substr(F.lit(1), n - 3)).otherwise(F.lit(""))
    # group the head in pairs from the right: reverse, comma after every 2, reverse
    grouped = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})", "$1,")), "^,", "")
    head_txt = F.when(n > 3, F.concat(grouped, F.lit(","))).otherwise(F.lit(""))
    return F.coalesce(F.concat(F.when(d < 0, F.lit("-")).otherwise(F.lit("")), F.lit("\u20b9"), head_txt, tail,
                               F.lit("."), fp), F.lit("not available"))


def humanize(x) -> Column:
    """'send_reminder' -> 'Send Reminder'."""
    return F.initcap(F.regexp_replace(_c(x), r"[_-]", " "))


def blank_to_null(x) -> Column:
    t = F.trim(_c(x).cast("string"))
    return F.when(t == "", F.lit(None)).otherwise(t)

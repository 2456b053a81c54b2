"""Column helpers: text, documents (CNPJ, CPF), money, keyed hashes. All are built-in expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from sentinela import constants as K


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def zfill(c: Column, n: int) -> Column:
    """Zeros in front up to ``n`` characters; longer text stays."""
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def decimal_comma(c: Column, kind: str = "decimal(18,2)") -> Column:
    """A number written with a decimal comma (the first comma); null if it is none."""
    return F.regexp_replace(strip(c), "^([^,]*),", "$1.").try_cast(kind)


def money(c: Column) -> Column:
    return F.format_number(c, 2)


def day(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.try_to_timestamp(strip(c), F.lit(pattern)).cast("date")


def document_kind(c: Column) -> Column:
    n = F.length(digits(c))
    return F.when(n == 11, "CPF").when(n == 14, "CNPJ")


def cnpj_format(c: Column) -> Column:
    """XX.XXX.XXX/XXXX-XX of 14 digits, else null."""
    d = digits(c)
    return F.when(F.length(d) == 14, F.regexp_replace(d, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5"))


def _check(d: Column, n: int, start: int) -> Column:
    """The modulo-11 check digit of the first ``n`` digits: weights fall from ``start`` to 2, then from 9 on."""
    weights, w = [], start
    for _ in range(n):
        weights.append(w)
        w = w - 1 if w > 2 else 9
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    return F.when(total % 11 < 2, 0).otherwise(11 - total % 11)


def _valid(c: Column, size: int, starts: tuple[int, int]) -> Column:
    d = digits(c)
    good = (_check(d, size - 2, starts[0]) == F.substring(d, size - 1, 1).cast("int")) & (_check(d, size - 1, starts[1]) == F.substring(d, size, 1).cast("int"))
    varied = ~d.rlike(r"^(\d)\1*$")
    return F.coalesce(F.when(F.length(d) == size, good & varied).otherwise(F.lit(False)), F.lit(False))


def cnpj_valid(c: Column) -> Column:
    return _valid(c, 14, (5, 6))


def cpf_valid(c: Column) -> Column:
    return _valid(c, 11, (10, 11))


def cpf_mask(c: Column) -> Column:
    """***.XXX.XXX-** with the middle six of 11 digits."""
    d = digits(c)
    return F.when(F.length(d) == 11, F.concat(F.lit("***."), F.substring(d, 4, 3), F.lit("."), F.substring(d, 7, 3), F.lit("-**")))


def visible_digits(c: Column) -> Column:
    """The six digits of a masked CPF, dotted or not."""
    plain, dotted = r"\*{3}(\d{3})(\d{3})\*{2}", r"\*{3}\.(\d{3})\.(\d{3})-\*{2}"
    return F.concat(*[F.coalesce(extract(strip(c), plain, g), extract(strip(c), dotted, g)) for g in (1, 2)])


def hmac_hex(c: Column, key: str) -> Column:
    """HMAC-SHA256 as hex of the UTF-8 text; null stays null. The pads that the plan shows are as secret as the key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(c, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def address_key(c: Column) -> Column:
    """street|number in upper case; null without a number."""
    a = strip(F.upper(c))
    number = extract(a, r",?\s*(\d+)")
    street = F.regexp_replace(strip(F.regexp_extract(a, r"^(.*?),?\s*\d+", 1)), ",+$", "")
    return F.when(number.isNotNull(), F.concat(street, F.lit("|"), number))


def object_category(c: Column) -> Column:
    """The category of a contract's object by key words, first match in order."""
    low, out = F.lower(c), None
    for name, words in K.OBJECT_WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def band(score: Column, bands=None) -> Column:
    out = None
    for least, label in bands or K.BANDS_BATCH:
        out = F.when(score >= least, label) if out is None else out.when(score >= least, label)
    return out

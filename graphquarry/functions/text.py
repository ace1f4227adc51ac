"""Text functions as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens, with camelCase cut in two. İ is an i, as one letter's lower case is one letter."""
    humps = F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(F.translate(humps, "\u0130", "i")), F.lit("[a-z0-9]+"), F.lit(0))


_HUMP, _TOKEN = re.compile("(?<=[a-z0-9])(?=[A-Z])"), re.compile("[a-z0-9]+")


def plain_tokens(text: str) -> list[str]:
    """``code_tokens`` of one text in a Python worker."""
    return _TOKEN.findall(_HUMP.sub(" ", text).replace("\u0130", "i").lower())


def query_words(text: Column) -> Column:
    """Lower-case words of more than two characters."""
    return F.filter(F.split(F.lower(text), "\\s+"), lambda w: F.length(w) > 2)


def like_escape(text: str) -> str:
    """A literal for LIKE ... ESCAPE '\\'."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def normal_url(url: Column) -> Column:
    """ssh addresses as https, no .git, no trailing slashes, lower case."""
    https = F.regexp_replace(url, "^(?:ssh://)?git@([^:/]+)[:/]", "https://$1/")
    return F.lower(F.regexp_replace(F.regexp_replace(https, "/+$", ""), "\\.git$", ""))


def ancestors(path: Column) -> Column:
    """Folders above a path, the deepest first, ending with '.'."""
    parts = F.split(path, "/")
    own = F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, F.concat(own, F.array(F.lit(".")))).otherwise(F.array(F.lit(".")))


def fixed(x: Column, digits: int) -> Column:
    """``x`` with so many digits after the point, rounded by its exact binary value as C's printf does; ``format_string`` rounds the
    shortest decimal form, so it takes 0.345, which lies below its half, up. The value may have up to 2**26 / 10**digits before the point."""
    ten = 10.0**digits
    size = F.abs(x)
    n = F.floor(size * ten)
    big = size * 134217729.0  # 2**27 + 1: the upper half of the bits, so that both products below are exact
    high = big - (big - size)
    over = (high * (2 * ten) - (2 * n + 1)) + (size - high) * (2 * ten)
    up = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.format_string(f"%.{digits}f", F.when(x < 0, -(up / ten)).when(F.isnan(x) | (size == float("inf")), x).otherwise(up / ten))


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(query, 256), 1, 16)


def file_extension(path: Column) -> Column:
    """Lower-case extension with its dot; none: .txt."""
    ext = F.regexp_extract(path, "[^/.][^/]*(\\.[^./]+)$", 1)
    return F.when(ext == "", F.lit(".txt")).otherwise(F.lower(ext))


def snippet(content: Column, start: Column, end: Column, most: int = 20) -> Column:
    """Lines start to end (from 1), ``most`` at most."""
    n = F.least(end, start - 1 + most) - (start - 1)
    return F.array_join(F.slice(F.split(content, "\n"), start, F.greatest(F.lit(0), n)), "\n")


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def base64url_hex(text: Column) -> Column:
    """Hex of unpadded url-safe base64."""
    plain = F.translate(text, "-_", "+/")
    return F.lower(F.hex(F.unbase64(F.rpad(plain, F.ceil(F.length(plain) / 4).cast("int") * 4, "="))))

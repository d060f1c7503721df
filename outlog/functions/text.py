"""Scalar text functions on log messages (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def template(message: ColumnOrName) -> Column:
    """Reduce a message to its ASCII letters, concatenated (spaces go too).

    ``"Order placed for 3 items"`` -> ``"Orderplacedforitems"``.  A whole log line becomes one
    word, the unit the encoder and the map work on.
    """
    return F.regexp_replace(_c(message), "[^a-zA-Z]", "")


def common_log_message(line: ColumnOrName) -> Column:
    """Message part of a common-log line: drop the first two single-space tokens.

    ``"[ts] [INFO] a b"`` -> ``"a b"``; a line with fewer than three tokens gives ``""``.
    """
    return F.array_join(F.slice(F.split(_c(line), " ", -1), 3, 2147483647), " ")


def common_log_token(line: ColumnOrName, i: int) -> Column:
    """Token ``i`` (1-based) of a common-log line with surrounding brackets removed."""
    tok = F.get(F.split(_c(line), " ", -1), i - 1)
    return F.regexp_replace(tok, r"^\[|\]$", "")


def strip_prefix(message: ColumnOrName) -> Column:
    """The ``strip_prefix`` formatter: when ``"] "`` occurs, keep only the second segment."""
    parts = F.split(_c(message), r"\] ", -1)
    return F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise(_c(message))


def to_str(c: ColumnOrName, data_type=None) -> Column:
    """String form of a non-message column: arrays become space-joined, the rest cast."""
    from pyspark.sql.types import ArrayType

    if data_type is not None and isinstance(data_type, ArrayType):
        return F.array_join(F.transform(_c(c), lambda x: x.cast("string")), " ")
    return _c(c).cast("string")


def fill_empty(c: ColumnOrName, filler: str = "EMPTY") -> Column:
    """Missing values become ``EMPTY`` (applied before cleaning and casting)."""
    return F.coalesce(_c(c), F.lit(filler))


def percent_encode(c: ColumnOrName) -> Column:
    """Percent-encode a string the way a URL path quoter does, keeping ``/`` as is.

    Java's form encoder differs in four places from path quoting: it writes ``+`` for a
    space, leaves ``*`` alone, encodes ``~`` and ``/``.  A literal ``+`` is encoded as
    ``%2B`` first, so every ``+`` left afterwards stands for a space.
    """
    e = F.url_encode(_c(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("%2F"), F.lit("/"))


def parse_bool(c: ColumnOrName) -> Column:
    """``'True'``/``'true'`` -> true, anything else -> false (null stays null)."""
    return F.lower(_c(c)) == F.lit("true")


def clean_whitespace(c: ColumnOrName) -> Column:
    """Strip leading and trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")

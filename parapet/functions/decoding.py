"""Encodings: writing them (corpus builder) and looking inside them (rule filter)."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from parapet import fixed_values as fv

# the token characters one by one: a class of single characters is a table lookup
_CLASS = string.ascii_letters + string.digits + "+/="
_TOKEN = fv.BASE64_TOKEN.replace("A-Za-z0-9+/=", _CLASS)


def base64_text(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def hex_text(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def rot13_text(text: Column) -> Column:
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    return F.translate(
        text, lower + upper, lower[13:] + lower[:13] + upper[13:] + upper[:13]
    )


def homoglyph_text(text: Column) -> Column:
    return F.translate(text, "".join(fv.CONFUSABLES), "".join(fv.CONFUSABLES.values()))


def lenient_base64_data(token: Column) -> Column:
    """The data characters a lenient decoder reads from a token.

    A "=" ends the data once it completes a quad (third character read, or two
    of them in a row after the second); elsewhere it is skipped.
    """
    start = F.struct(
        F.lit("").alias("data"), F.lit(True).alias("first"), F.lit(False).alias("done")
    )

    def take(state: Column, piece: Column) -> Column:
        position = F.length(state["data"]) % 4
        ends = (~state["first"]) & (
            state["done"] | (position == 3) | ((position == 2) & (piece == ""))
        )
        return F.struct(
            F.when(ends, state["data"]).otherwise(F.concat(state["data"], piece)).alias("data"),
            F.lit(False).alias("first"),
            ends.alias("done"),
        )

    return F.aggregate(F.split(token, "="), start, take, lambda state: state["data"])


def decoded_text(token: Column) -> Column:
    """UTF-8 text inside a base64 token, invalid bytes dropped; null if the
    number of data characters cannot be decoded."""
    data = lenient_base64_data(token)
    text = F.make_valid_utf8(F.unbase64(data).cast("string"))
    return F.when(F.length(data) % 4 != 1, F.replace(text, F.lit("\ufffd"), F.lit("")))


def decode_scan(content: Column, may_hold: Column | None = None) -> Column:
    """True if some base64 token hides one of the decoded keywords.

    ``may_hold`` is False only for texts known to hold no token.
    """
    tokens = F.regexp_extract_all(content, F.lit(_TOKEN), F.lit(0))
    keywords = "(?i)" + "|".join(fv.DECODED_KEYWORDS)
    found = F.exists(
        tokens, lambda token: F.coalesce(decoded_text(token).rlike(keywords), F.lit(False))
    )
    # most texts hold no token at all, which a plain search tells sooner
    likely = content.rlike(f"[{_CLASS}]{{20}}") if may_hold is None else may_hold
    return F.when(likely, found).otherwise(F.lit(False))

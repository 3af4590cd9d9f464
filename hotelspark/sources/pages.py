"""Readable text of web pages."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text of all named character references of HTML that end in a semicolon, as one JSON object.
NAMED = json.dumps({name.removesuffix(";"): text for name, text in html5.items() if name.endswith(";")})


def _decode_numeric(c: Column) -> Column:
    """Decimal and hexadecimal references, resolved only in texts that have any."""
    bits = F.split(c, r"(?=&#)")
    def one(bit: Column) -> Column:
        dec = F.regexp_extract(bit, r"^&#(\d{1,7});", 1).try_cast("int")
        hexa = F.conv(F.nullif(F.regexp_extract(bit, r"^&#[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10).try_cast("int")
        code = F.coalesce(dec, hexa)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        rest = F.regexp_replace(bit, r"^&#[xX]?[0-9a-fA-F]+;", "")
        return F.when(valid, F.concat(char, rest)).otherwise(bit)
    return F.when(c.contains("&#"), F.array_join(F.transform(bits, one), "")).otherwise(c)


def _decode_named(c: Column) -> Column:
    """Named references, looked up only in texts that have any; unknown names stay."""
    names = F.from_json(F.lit(NAMED), "map<string,string>")

    def one(bit: Column) -> Column:
        name = F.regexp_extract(bit, r"^&([a-zA-Z][a-zA-Z0-9]*);", 1)
        text = F.try_element_at(names, name)
        return F.when(text.isNotNull(), F.concat(text, F.substr(bit, F.length(name) + 3))).otherwise(bit)

    return F.when(c.rlike("&[a-zA-Z][a-zA-Z0-9]*;"), F.array_join(F.transform(F.split(c, "(?=&[a-zA-Z])"), one), "")).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Every reference is read once: what one stands for never starts another."""
    return _decode_named(_decode_numeric(c))


def page_text(html: Column, limit: int | None = None) -> Column:
    """Text of a page: scripts, styles, comments and tags out, white space tidied.

    Lines are trimmed, cut at double spaces, and their non-empty pieces joined by single spaces. The whole page
    is read and kept; ``limit``, where given, shortens the result to so many characters and adds "...".
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?s)<[!/?a-zA-Z][^>]*>", "")
    pieces = F.transform(
        F.split(decode_entities(bare), r"\r\n|[\r\n\f\x0b\x1c-\x1e\x85  ]|  "),
        lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", ""),
    )
    text = F.array_join(F.filter(pieces, lambda x: x != ""), " ")
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def html_to_text(pages: DataFrame, limit: int | None = None, html: str = "html") -> DataFrame:
    return pages.withColumn("text", page_text(F.col(html), limit)).drop(html)

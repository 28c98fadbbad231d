"""Text columns by the rules of chat exports: Unicode white space, UTF-16 lengths, fingerprints, HTML and XML entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space (tab to carriage return, the Unicode spaces and line ends, U+FEFF).
SPACES = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Control and invisible characters that cleaning strips; tab, line feed and carriage return stay.
CONTROLS = r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F\u200B-\u200F\u2028\u2029\uFEFF]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a plain expression would be computed wherever it is named."""
    return F.transform(F.array(value), body)[0]


#: The same characters one by one.
SPACE_CHARS = "".join(chr(c) for c in (*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))


def trim(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(SPACE_CHARS))


def strip_controls(x: Column) -> Column:
    return F.regexp_replace(x, CONTROLS, "")


def utf16_length(x: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(x, "UTF-16BE")) / 2).cast("int")


def preview(x: Column, units: int = 200) -> Column:
    """The first UTF-16 units of a text, with an ellipsis where there are more."""
    start = F.decode(F.substring(F.encode(x, "UTF-16BE"), 1, 2 * units), "UTF-16BE")
    return F.when(utf16_length(x) > units, F.concat(start, F.lit("…"))).otherwise(x)


def lines(x: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(x, r"\r?\n"), trim), lambda v: v != "")


def fingerprint(x: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the text without white space, in lower case."""
    return F.substring(F.sha2(F.lower(F.translate(x, SPACE_CHARS, "")), 256), 1, 16)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text: what is malformed becomes U+FFFD, a byte order mark goes."""
    return without_bom(F.make_valid_utf8(content.cast("string")))


def without_bom(x: Column) -> Column:
    return F.regexp_replace(x, r"\A\uFEFF", "")


def literal(replacement: str) -> str:
    """A replacement that ``regexp_replace`` takes as it is."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def replace_first(x: Column, pattern: str, replacement: str) -> Column:
    """Replace the first hit of a pattern only."""

    def put(v: Column) -> Column:
        at, hit = F.regexp_instr(v, F.lit(pattern)), F.regexp_substr(v, F.lit(pattern))
        rest = F.substring(v, at + F.length(hit), F.length(v))
        return F.when(at > 0, F.concat(F.substring(v, F.lit(1), at - 1), F.lit(replacement), rest)).otherwise(v)

    return let(x, put)


#: Named entities and what they stand for, in the order of replacement; ``amp`` comes last.
XML_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
HTML_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "hellip": "…"}


def decode_entities(x: Column, named: dict[str, str] | None = None) -> Column:
    """Numeric entities first (impossible code points vanish), then the named ones, ``&amp;`` last."""
    named = HTML_ENTITIES if named is None else named

    def numeric(x: Column, pattern: str, base: int) -> Column:
        pieces, hits = F.split(x, pattern), F.regexp_extract_all(x, F.lit(pattern), F.lit(1))

        def char(digits: Column) -> Column:
            digits = F.regexp_replace(digits, r"\A0+(?=.)", "")
            code = F.when(F.length(digits) <= 8, (F.conv(digits, 16, 10) if base == 16 else digits).try_cast("long"))
            fits = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
            return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")

        parts = F.zip_with(pieces, hits, lambda p, h: F.concat(p, F.when(h.isNull(), "").otherwise(char(h))))
        return F.when(F.size(hits) > 0, F.array_join(parts, "")).otherwise(x)

    out = numeric(numeric(x, "&#x([0-9a-fA-F]+);", 16), "&#([0-9]+);", 10)
    for name, char_ in named.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char_))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


#: Elements whose content is dropped, elements that end a line, and the patterns of titles, tags and comments.
DROPPED = "script|style|noscript|template|svg|head"
BLOCKS = "p|div|li|tr|h[1-6]|blockquote|section|article|ul|ol|table|pre|td|th|dt|dd|hr"
TITLE, TAG, COMMENT, BREAK = r"(?is)<title[^>]*>(.*?)</title>", "<[^>]+>", r"(?s)<!--.*?-->", r"(?i)<br\s*/?>"


def html_title(x: Column) -> Column:
    """The text of the first title element, or null."""
    inner = decode_entities(F.regexp_replace(F.regexp_extract(x, TITLE, 1), TAG, ""))
    return F.when(x.rlike(TITLE), trim(F.regexp_replace(inner, f"[{SPACES}]+", " ")))


def html_blocks(x: Column) -> Column:
    """The text of a page as lines: comments and invisible elements out, entities decoded, spaces collapsed."""
    x = F.regexp_replace(x, COMMENT, " ")
    x = F.regexp_replace(x, rf"(?is)<({DROPPED})\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, BREAK, "\n")
    x = F.regexp_replace(x, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    x = decode_entities(F.regexp_replace(x, TAG, " "))
    return F.filter(F.transform(F.split(x, r"\n+"), lambda v: trim(F.regexp_replace(v, r"[ \t\u00A0]+", " "))), lambda v: v != "")

"""Column functions on text: pre-tokens, special tokens, bytes as symbols. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The pre-token pattern and the document delimiter.
PRETOKEN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = "<|endoftext|>"

#: Stands between pre-tokens in a string of symbols; no id has this character.
SEPARATOR = chr(0x10FFFE)


def pretokens(text: Column) -> Column:
    """Pre-tokens of a text, in order. ``(?U)`` makes the classes those of Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN_PATTERN), F.lit(0))


def longest_first(specials: Sequence[str]) -> list[str]:
    """Distinct special tokens, longest first; equal lengths keep their order."""
    return sorted(dict.fromkeys(s for s in specials if s), key=len, reverse=True)


def special_pattern(specials: Sequence[str]) -> str | None:
    """A Java pattern that matches any special token, the longest where several fit."""
    found = longest_first(specials)
    return "|".join(r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E" for s in found) or None


def split_specials(text: Column, specials: Sequence[str], keep: bool = False) -> Column:
    """Pieces of a text between special tokens; with ``keep``, the tokens stay as pieces of
    their own and empty pieces go."""
    pattern = special_pattern(specials)
    if pattern is None:
        return F.filter(F.array(text), lambda p: p != "") if keep else F.array(text)
    parts = F.split(text, pattern, -1)
    if not keep:
        return parts
    marks = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))
    woven = F.flatten(F.zip_with(parts, marks, lambda p, m: F.array(p, m)))
    return F.filter(woven, lambda p: p.isNotNull() & (p != ""))


def byte_symbols(word: Column) -> Column:
    """UTF-8 bytes of a string as one character each: byte b is U+00b."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def adjacent(s: Column) -> Column:
    """Each two neighbouring characters of a string, in order."""
    halves = [F.slice(F.split(s, ""), k, F.greatest(F.length(s) - 1, F.lit(0))) for k in (1, 2)]
    return F.when(F.length(s) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(*halves, lambda a, b: F.concat(a, b)))


def symbol(i: int) -> str:
    """The character that stands for a token id; the surrogates' range is left out."""
    return chr(i if i < 0xD800 else i + 0x800)


def symbol_id(character: str) -> int:
    """The id that a character stands for."""
    code = ord(character)
    return code if code < 0xD800 else code - 0x800


def symbol_ids(symbols: Column) -> Column:
    """Ids of a string of symbols, in order."""
    code = lambda c: F.when(F.ascii(c) < 0xD800, F.ascii(c)).otherwise(F.ascii(c) - 0x800)
    return F.when(symbols == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(symbols, ""), code))


def strip_newlines(text: Column) -> Column:
    """A text without the carriage returns and line feeds at its ends."""
    return F.btrim(text, F.lit("\r\n"))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient; null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def printable(byte: Column) -> Column:
    """The printable character that stands for a byte in vocabulary files: itself where it can
    be seen, else 256 and up in byte order."""
    hidden = F.filter(F.sequence(F.lit(0), F.lit(255)), lambda b: ~_seen(b))
    return F.when(_seen(byte), _character(byte)).otherwise(_character(F.lit(255) + F.array_position(hidden, byte.cast("int")).cast("int")))


def _seen(byte: Column) -> Column:
    return byte.between(33, 126) | byte.between(161, 172) | byte.between(174, 255)


def _character(code: Column) -> Column:
    hexed = F.lpad(F.hex(code), 4, "0")
    return F.decode(F.unhex(hexed), "UTF-16BE")

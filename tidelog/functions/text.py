"""Text primitives and the message normaliser, as Column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Java's trim takes away.
CONTROLS = "".join(map(chr, range(0x21)))
#: The normaliser's patterns and what stands for a match, in the order of application. A word boundary is spelt out, as
#: letters, marks, digits and the underscore of any script, so that it does not depend on the regex engine.
#: What a match begins with is looked for first and the boundary behind it only then, which spares most places the look back. Folders of a path are taken for good, each only if a name follows: so the engine
#: keeps no stack of them, and a line of any number of slashes does no harm.
EDGE_L, EDGE_R = r"(?<![\p{L}\p{M}\p{Nd}_])", r"(?![\p{L}\p{M}\p{Nd}_])"
UUID = r"(?=[0-9a-fA-F]{8}-)" + EDGE_L + r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}" + EDGE_R
IPV4 = r"(?=\d{1,3}\.)" + EDGE_L + r"(?:\d{1,3}\.){3}\d{1,3}" + EDGE_R
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"
NAME = r"""[^\\/:*?"<>|\r\n]"""
PATH = rf"(?:[A-Za-z]:\\|/)(?:{NAME}++[\\/](?={NAME}))*+({NAME}+)"
PLAYER = r"(?=player_)" + EDGE_L + r"player_\d+" + EDGE_R
ITEM = r"(?=item_)" + EDGE_L + r"item_([a-zA-Z]+)_\d+" + EDGE_R
ADDRESS = r"@[0-9a-fA-F]+"
NUMBER = r"(?=\d)" + EDGE_L + r"\d+" + EDGE_R


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def jtrim(c: Column) -> Column:
    """Both ends without characters up to U+0020: more than SQL's trim, which takes spaces only."""
    return F.btrim(c, F.lit(CONTROLS))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | c.rlike(r"^[\s\x1c-\x1f]*$")


def first_line(c: Column) -> Column:
    """Up to the first newline; a carriage return before it stays, and goes with jtrim."""
    return F.substring_index(c, "\n", 1)


def only_newlines(c: Column) -> Column:
    """Such a text has no first line at all; records with it are set aside."""
    return F.coalesce(c.rlike(r"^(?:\r?\n)++$"), F.lit(False))


def mask_uuids(c: Column) -> Column:
    return F.regexp_replace(c, UUID, "UUID")


def mask_ips(c: Column) -> Column:
    """Octets are not checked for range."""
    return F.regexp_replace(c, IPV4, "IP")


def mask_timestamps(c: Column) -> Column:
    return F.regexp_replace(c, TIMESTAMP, "TIMESTAMP")


def mask_paths(c: Column) -> Column:
    """Folders go, the file name stays. Any slash begins a path."""
    return F.regexp_replace(c, PATH, "PATH/$1")


def mask_players(c: Column) -> Column:
    return F.regexp_replace(c, PLAYER, "player_N")


def mask_items(c: Column) -> Column:
    return F.regexp_replace(c, ITEM, "item_$1_N")


def mask_addresses(c: Column) -> Column:
    return F.regexp_replace(c, ADDRESS, "@ADDR")


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, "N")


STEPS = (mask_uuids, mask_ips, mask_timestamps, mask_paths, mask_players, mask_items, mask_addresses, mask_numbers)
#: What a text must hold for a step to change it; the others look at digits, which most messages have.
NEEDED = {mask_uuids: "-", mask_paths: "[/\\\\]", mask_players: "player_", mask_items: "item_", mask_addresses: "@"}
#: A text without any of these can only have its numbers masked: a time has hyphens, an address dots.
ANY_NEEDED = ("-", ".", "/", "\\", "@", "player_", "item_")


def normalize_message(c: Column) -> Column:
    """What varies between occurrences of one message, masked. Null and empty stay."""
    return let(c, normalize_value)


def normalize_value(x: Column) -> Column:
    """As ``normalize_message``, of a column or field, which costs nothing to be named often."""
    return F.when(reduce(Column.__or__, [F.contains(x, F.lit(part)) for part in ANY_NEEDED]), _all_steps(x)).otherwise(mask_numbers(x))


def _all_steps(c: Column) -> Column:
    for step in STEPS:
        c = let(c, _where_needed(step)) if step in NEEDED else step(c)
    return c


def _where_needed(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x.rlike(NEEDED[step]), step(x)).otherwise(x)


def exception_type(archive: Column) -> Column:
    """What stands before the first colon of the trimmed first line, if it has a dot; else null."""
    return let(jtrim(first_line(archive)), type_of_line)


def message(archive: Column) -> Column:
    """What follows the first colon of the trimmed first line, or the whole line; null for a null or empty archive."""
    return F.when(F.length(archive) > 0, let(jtrim(first_line(archive)), message_of_line))


def type_of_line(line: Column) -> Column:
    part = jtrim(F.substring_index(line, ":", 1))
    return F.when(F.contains(line, F.lit(":")), let(part, lambda p: F.when(F.contains(p, F.lit(".")), p)))


def message_of_line(line: Column) -> Column:
    return F.when(F.contains(line, F.lit(":")), jtrim(line.substr(F.instr(line, ":") + 1, F.length(line)))).otherwise(line)


def issue_title(archive: Column) -> Column:
    """The trimmed first line, cut at 500 characters; null and empty archives have a title of their own."""
    cut = lambda line: F.when(F.length(line) > 500, F.concat(F.substring(line, 1, 497), F.lit("..."))).otherwise(line)
    return F.when(F.coalesce(F.length(archive), F.lit(0)) == 0, F.lit("Unknown Error")).otherwise(let(jtrim(first_line(archive)), cut))


#: The initial consonants of Hangul syllables, in their order; each begins 588 syllables from U+AC00 on.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"


def choseong(c: Column) -> Column:
    """Each Hangul syllable as its initial consonant; other characters stay. A search key for names."""
    initials = F.array(*(F.lit(x) for x in INITIALS))
    one = lambda x: F.when(x.between("가", "힣"), F.get(initials, F.floor((F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("int") - 0xAC00) / 588).cast("int"))).otherwise(x)
    return F.array_join(F.transform(F.split(c, ""), one), "")

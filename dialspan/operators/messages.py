"""The grammar of log lines and of SIP messages, as expressions over text.

Lines are read by position and by separators; what a part is, its shape or a cast decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = 2**31 - 1
# Shapes of times, in which 0 stands for any digit.
STAMP, COMPACT, MILLIS = "0000-00-00 00:00:00", "00000000-000000.0", "0000-00-00 00:00:00:000"
NIL_UUID = "00000000-0000-0000-0000-000000000000"
# RFC 3261: the version that every start line has.
SIP_VERSION = "SIP/2.0"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tail(text: Column, n: int) -> Column:
    """The text without its first ``n`` characters."""
    return F.substring(text, n + 1, REST)


def behind(text: Column, mark: str) -> Column:
    """What follows the first ``mark``; NULL where there is none."""
    return F.get(F.split(text, re.escape(mark), 2), F.lit(1))


def bind(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once a row: filters and columns that use it aren't pushed below it, where each would work it out anew."""
    return df.withColumn(name, F.explode(F.array(value)))


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def shaped(text: Column, shape: str, digits: str = "123456789") -> Column:
    """The head of a text that has a shape, in which 0 stands for any of ``digits``; NULL for another."""
    head = F.substring(text, 1, len(shape))
    return F.when(F.translate(head, digits, "0" * len(digits)) == shape, head)


def parse_timestamp(line: Column | str) -> Column:
    """The time at a line's beginning, in a bracket or not, or behind a word and a bar; without zone, NULL for none."""
    line = F.col(line) if isinstance(line, str) else line
    fraction = lambda text: F.regexp_extract(text, r"^[.]\d+", 0)
    bare = F.when(line.startswith("["), tail(line, 1)).otherwise(line)
    plain = F.concat(shaped(bare, STAMP), fraction(tail(bare, len(STAMP)))).try_cast("timestamp_ntz")
    c = F.ltrim(behind(line, "|"))
    part = lambda at, n=2: F.substring(c, at, n)
    made = F.concat(part(1, 4), F.lit("-"), part(5), F.lit("-"), part(7), F.lit(" "), part(10), F.lit(":"), part(12), F.lit(":"), part(14), fraction(tail(c, len(COMPACT) - 2)))
    named = F.rtrim(F.substring_index(line, "|", 1)).rlike(r"^\w+$")
    return F.coalesce(plain, F.when(shaped(c, COMPACT).isNotNull() & named, made.try_cast("timestamp_ntz")))


def millisecond_stamp(text: Column) -> Column:
    """The time at a text's beginning whose milliseconds stand after a colon; NULL for none."""
    at = F.when(F.substring(text, len(MILLIS) + 1, 1).rlike(r"\s"), shaped(text, MILLIS))
    return F.concat(F.substring(at, 1, len(STAMP)), F.lit("."), F.substring(at, len(STAMP) + 2, 3)).try_cast("timestamp_ntz")


def tagged(text: Column) -> Column:
    """(tag, level, message) of ``[time] [tag] [level] message``; NULL where the brackets aren't there."""
    inner = lambda part: tail(F.ltrim(part), 1)

    def made(parts: Column) -> Column:
        whole = (F.size(parts) == 4) & F.forall(F.slice(parts, 1, 3), lambda x: F.ltrim(x).startswith("["))
        return F.when(whole, F.struct(inner(F.get(parts, F.lit(1))).alias("tag"), inner(F.get(parts, F.lit(2))).alias("level"), F.ltrim(F.get(parts, F.lit(3))).alias("message")))

    return let(F.split(text, "]", 4), made)


def finite(text: Column) -> Column:
    """The number that a text is; NULL for none, and for what isn't finite."""
    return let(text.try_cast("double"), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def geo_uri(text: Column) -> Column:
    """(latitude, longitude) of ``geo:latitude,longitude;parameters`` (RFC 5870, without altitude); NULL for another text."""
    pair = F.split(F.substring_index(behind(text, "geo:"), ";", 1), ",")
    place = lambda p: F.when(F.size(p) == 2, F.struct(finite(F.get(p, F.lit(0))).alias("latitude"), finite(F.get(p, F.lit(1))).alias("longitude")))
    return F.when(text.startswith("geo:"), let(pair, place))


def is_uuid(text: Column) -> Column:
    """Whether a text in lower case is a UUID that isn't nil."""
    return F.coalesce((F.length(text) == len(NIL_UUID)) & shaped(text, NIL_UUID, "123456789abcdef").isNotNull() & (text != NIL_UUID), F.lit(False))


# --- SIP ---------------------------------------------------------------------------------


def trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))


def begins_message(line: Column) -> Column:
    """Whether a line is a status line (version, code, reason) or a request line (method, address, version)."""

    def made(words: Column) -> Column:
        first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
        status = (first == SIP_VERSION) & shaped(second, "000").isNotNull()
        address = second.startswith("sip:") | second.startswith("sips:")
        request = (F.size(words) > 2) & (F.element_at(words, -1) == SIP_VERSION) & address & (first != "") & (F.translate(first, LETTERS, "") == "")
        return F.coalesce(status | request, F.lit(False))

    return F.when(line.contains(SIP_VERSION), let(F.split(line, " "), made)).otherwise(F.lit(False))


def sip_message(text: Column) -> Column:
    """(title, headers): the line that a SIP message begins with, and the lines from there to the first blank one, never the body; NULL without a message."""

    def until_blank(rest: Column) -> Column:
        return let(F.array_position(rest, F.lit("")).cast("int"), lambda end: F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest))

    def from_title(lines: Column, at: Column) -> Column:
        rest = F.slice(lines, at + 1, F.size(lines))
        return F.when(at > 0, F.struct(F.get(lines, at - 1).alias("title"), let(rest, until_blank).alias("headers")))

    place = lambda lines: F.array_position(F.transform(lines, begins_message), True).cast("int")
    return F.when(text.contains(SIP_VERSION), let(trimmed_lines(text), lambda lines: let(place(lines), lambda at: from_title(lines, at))))


def with_headers(records: DataFrame) -> DataFrame:
    """``records`` with ``_title`` and ``_headers`` of the SIP message in their text."""
    rows = bind(records, "_sip", sip_message(F.col("text")))
    return rows.withColumns({"_title": F.col("_sip.title"), "_headers": F.col("_sip.headers")}).drop("_sip")


def is_header(line: Column, names: tuple[str, ...]) -> Column:
    return line.contains(":") & F.lower(F.rtrim(F.substring_index(line, ":", 1))).isin(*names)


def header_of(lines: Column | str, *names: str) -> Column:
    """The value of the first line with one of the header names (in lower case); NULL for none."""
    first = F.get(F.filter(lines, lambda x: is_header(x, names)), F.lit(0))
    return F.nullif(F.btrim(behind(first, ":")), F.lit(""))


def header(*names: str) -> Column:
    return header_of("_headers", *names)


def word(text: Column, n: int = 0) -> Column:
    return F.get(F.split(text, r"\s+"), F.lit(n))


def parameters(value: Column) -> Column:
    """The parameters of a header's value in lower case and without blanks."""
    return F.transform(F.split(value, ";"), lambda x: F.translate(F.lower(x), " \t", ""))


def response_code(title: Column) -> Column:
    return F.when(title.startswith(SIP_VERSION), shaped(tail(title, len(SIP_VERSION) + 1), "000")).cast("int")


def identity(value: Column) -> Column:
    """The address in a header's value, without scheme and parameters; the value where there is none."""
    return F.coalesce(F.nullif(F.get(F.split(F.get(F.split(value, "sips?:", 2), F.lit(1)), r"[>;\s]"), F.lit(0)), F.lit("")), value)

"""String, URL and time expressions. Everything stays a JVM-side Column."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

# Fixed value: the characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def digest_number(*columns: Column) -> Column:
    """A number of 60 bits from a digest of the columns' text; repeats on every engine."""
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def at(as_of: datetime | str) -> Column:
    """The run's notion of "now" as a foldable literal, so filters on it reach the scan."""
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOURS")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAYS")


def _url_without_control_chars(url: Column) -> Column:
    return F.translate(F.regexp_replace(url, r"^[\x00-\x20]+", ""), "\t\r\n", "")


_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
# Fixed value: schemes whose last path segment may carry ";params".
_PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "sip", "sips", "mms", "sftp", "tel"]


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_url_without_control_chars(url), _SCHEME, 1))


def canonical_url(url: Column) -> Column:
    """scheme + authority + path; query, fragment and last-segment ``;params`` are cut."""
    base = F.regexp_replace(_url_without_control_chars(url), r"(?s)[?#].*$", "")
    rest = F.regexp_replace(base, _SCHEME, "")
    authority = F.regexp_extract(rest, r"^(//[^/]*)?", 0)
    path = F.regexp_replace(rest, r"^//[^/]*", "")
    scheme = url_scheme(url)
    path = F.when(scheme.isin(_PARAM_SCHEMES), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), authority, path)


def url_domain(url: Column) -> Column:
    """Lowercase authority, port and user info included; '' when there is none."""
    return F.lower(
        F.regexp_extract(_url_without_control_chars(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    )


def robots_url(domain: Column) -> Column:
    return F.concat(F.lit("https://"), domain, F.lit("/robots.txt"))


def percent_decode(text: Column) -> Column:
    """Decode valid %XX pairs only; a plus sign stays a plus sign."""
    safe = F.replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(safe)


def percent_encode(text: Column) -> Column:
    """RFC 3986 encoding that leaves unreserved characters and '/' alone."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


_ISO = (
    r"^(\d{4})(?:-(\d{2})(?:-(\d{2}))?|(\d{2})(\d{2}))?"
    r"(?:(?<=\d{4}-\d{2}-\d{2}|\d{8})\D(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|z|[+-]\d{2}(?::?\d{2})?)?)?$"
)


_WEEK_DATE = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?(?=$|\D)"
_YEAR_DAY = r"^(\d{4})-?(\d{3})(?=$|\D)"


def _calendar_date(text: Column) -> Column:
    """Week dates (YYYY-Www[-D]) and year days (YYYY-DDD) rewritten as YYYY-MM-DD; impossible ones are NULL."""
    def number(pattern: str, i: int) -> Column:
        return F.regexp_extract(text, pattern, i).try_cast("int")

    week, weekday = number(_WEEK_DATE, 2), F.coalesce(number(_WEEK_DATE, 3), F.lit(1))
    first_monday = F.to_date(F.date_trunc("week", F.make_date(number(_WEEK_DATE, 1), F.lit(1), F.lit(4))))
    monday = F.date_add(first_monday, (week - 1) * 7)
    # A week belongs to the year of its Thursday.
    real_week = week.between(1, 53) & (F.year(F.date_add(monday, F.lit(3))) == number(_WEEK_DATE, 1))
    year_day = F.date_add(F.make_date(number(_YEAR_DAY, 1), F.lit(1), F.lit(1)), number(_YEAR_DAY, 2) - 1)
    real_day = F.year(year_day) == number(_YEAR_DAY, 1)

    def rewritten(date: Column, pattern: str) -> Column:
        return F.concat(F.date_format(date, "yyyy-MM-dd"), F.regexp_replace(text, pattern, ""))

    return (
        F.when(text.rlike(_WEEK_DATE), F.when(real_week, rewritten(F.date_add(monday, weekday - 1), _WEEK_DATE)))
        .when(text.rlike(_YEAR_DAY), F.when(real_day, rewritten(year_day, _YEAR_DAY)))
        .otherwise(text)
    )


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a UTC instant; anything else is NULL.

    Accepts YYYY, YYYY-MM, YYYY-MM-DD, YYYYMMDD, week dates, year days and, after
    a full date, one separator character with hh[:mm[:ss[.f]]] and an optional Z
    or offset.
    """
    # transform() over a one-element array names an intermediate value once; the
    # optimizer would copy a plain expression into each of its many uses.
    def bind(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def instant(fields: Column) -> Column:
        def part(i: int) -> Column:
            return F.nullif(F.get(fields, i - 1), F.lit(""))

        month, day = F.coalesce(part(2), part(4), F.lit("01")), F.coalesce(part(3), part(5), F.lit("01"))
        hour, minute, second, fraction = (F.coalesce(part(i), F.lit("00")) for i in (6, 7, 8, 9))
        midnight = F.concat(hour, minute, second, fraction).rlike("^240+$")
        local = F.concat(
            F.concat_ws("-", part(1), month, day), F.lit(" "),
            F.concat_ws(":", F.when(midnight, "00").otherwise(hour), minute, second), F.lit("."), fraction,
        ).try_cast("timestamp_ntz")
        digits = F.regexp_replace(part(10), "[^0-9]", "")
        minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
        east = F.when(F.startswith(part(10), F.lit("-")), -1).otherwise(1)
        shift = F.when(midnight, 1440).otherwise(0) - F.coalesce(minutes * east, F.lit(0))
        return local + F.make_dt_interval(F.lit(0), F.lit(0), shift)

    def read(iso: Column) -> Column:
        fields = F.split(F.regexp_replace(iso, _ISO, "|".join(f"${i}" for i in range(1, 11))), r"\|")
        return F.when(iso.rlike(_ISO), bind(fields, instant))

    return bind(_calendar_date(text), read)


def label_for(score: Column, positive: Column, negative: Column) -> Column:
    return F.when(score >= positive, "positive").when(score <= negative, "negative").otherwise("neutral")


def is_upper(word: Column) -> Column:
    """At least one cased letter and no lowercase one."""
    return (F.upper(word) == word) & (F.lower(word) != word)

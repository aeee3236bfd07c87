"""The string and value functions as Catalyst expressions: no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space code points as a regular-expression class (no U+FEFF).
SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def clean_text(s: Column) -> Column:
    """Line ends and no-break spaces become one space; soft hyphens, zero-width spaces, marks and controls go."""
    spaced = F.regexp_replace(F.regexp_replace(s, r"\r\n|\r|\n", " "), r"\x{A0}", " ")
    return F.regexp_replace(spaced, r"[\x{AD}\x{200B}\x{FEFF}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")


def collapse_space(s: Column) -> Column:
    return F.regexp_replace(s, f"[{SPACE}]+", " ")


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def lines(s: Column) -> Column:
    """At LF or CRLF, without an empty one at the end."""
    parts = F.split(s, r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def paragraphs(s: Column) -> Column:
    """Trimmed, non-empty chunks between blank lines."""
    whole = F.regexp_replace(s, r"\r\n?", "\n")
    return F.filter(F.transform(F.split(whole, r"\n(?:[ \t]*\n)+", -1), trim_space), lambda p: p != "")


def file_extension(path: Column) -> Column:
    """Lower-cased, of the last path step; none for names that begin or end with their only dot."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^/\\.]+)$", 1))


def file_stem(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def is_absolute_uri(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~s.rlike(r"^[A-Za-z]:[\\/]")


def sanitize_id(s: Column) -> Column:
    """Lower-case ASCII letters, digits, underscores and single dashes."""
    low = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_-]+|-+", "-"), "-+", "-")
    out = F.regexp_replace(out, "^-|-$", "")
    return F.when(out == "", "anchor").otherwise(out)


def gfm_slug(s: Column) -> Column:
    """A heading's fragment: letters, numbers, marks, connectors, hyphens; spaces are hyphens."""
    marks = r"\x{300}-\x{36F}\x{483}-\x{489}\x{900}-\x{903}\x{93A}-\x{94F}\x{951}-\x{957}\x{962}-\x{963}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}"
    connectors = r"_\x{203F}\x{2040}\x{2054}\x{FE33}\x{FE34}\x{FE4D}-\x{FE4F}\x{FF3F}"
    kept = F.regexp_replace(F.replace(F.lower(trim_space(s)), F.lit(" "), F.lit("-")), rf"[^\p{{L}}\p{{N}}\-{marks}{connectors}]", "")
    return F.when(kept == "", "section").otherwise(kept)


def format_url(s: Column) -> Column:
    """A link destination: brackets and bars coded, in angle brackets if space or parentheses are left."""
    coded = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "<", "%3C"), ">", "%3E"), r"\|", "%7C")
    return F.when(coded.rlike(f"[(){SPACE}]"), F.concat(F.lit("<"), coded, F.lit(">"))).otherwise(coded)


def backtick_fence(s: Column, least: int) -> Column:
    longest = F.array_max(F.transform(F.regexp_extract_all(s, F.lit("`+"), F.lit(0)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(longest, F.lit(0)) + 1, F.lit(least)))


def fenced(s: Column, language: Column) -> Column:
    body = F.regexp_replace(s, r"\n+\z", "")
    fence = backtick_fence(s, 3)
    return F.concat(fence, language, F.lit("\n"), body, F.lit("\n"), fence, F.lit("\n"))


def alpha_label(n: Column) -> Column:
    """Bijective base 26; nothing and less are written as they are."""
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(14)),
        F.struct(n.cast("long").alias("n"), F.lit("").alias("s")),
        lambda a, _: F.when(a["n"] <= 0, a).otherwise(
            F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char(97 + (a["n"] - 1) % 26), a["s"]).alias("s"))
        ),
        lambda a: a["s"],
    )
    return F.when(n <= 0, n.cast("string")).otherwise(steps)


def roman_label(n: Column) -> Column:
    digits = [
        ["", "m", "mm", "mmm"],
        ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"],
        ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"],
        ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"],
    ]
    parts = [F.element_at(F.array(*map(F.lit, d)), (F.floor(n / p) % 10 + 1).cast("int")) for d, p in zip(digits, (1000, 100, 10, 1), strict=True)]
    return F.when((n <= 0) | (n > 3999), n.cast("string")).otherwise(F.concat(*parts))


def cell_kind(s: Column) -> Column:
    """number, bool, date or text; null for nothing."""
    v = trim_space(s)
    digits = F.regexp_replace(F.regexp_replace(v, "%$", ""), r"[, _\x{A0}]", "")
    clock = r"[0-9]{1,4}(:[0-9]{1,4}){1,2}"
    day = "|".join(rf"[0-9]{{1,4}}{sep}[0-9]{{1,4}}{sep}[0-9]{{1,4}}" for sep in ("-", "/", r"\."))
    return (
        F.when(v == "", None)
        .when(digits.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "number")
        .when(F.lower(v).isin("true", "false", "yes", "no"), "bool")
        .when(v.rlike(rf"^({day})([T ]({clock})?(\.[^Z]*)?Z?)?$") | v.rlike(rf"^{clock}$"), "date")
        .otherwise("text")
    )


def strip_ansi(s: Column) -> Column:
    return F.regexp_replace(s, r"\x1B\[[^@-~]*([@-~]|\z)", "")


def excel_date(serial: Column) -> Column:
    """Days since the end of 1899 as a date with a clock if there is one; before March 1900 a day is added."""
    seconds = F.round(serial * 86400).cast("long") + F.when(serial < 60, 86400).otherwise(0)
    moment = F.timestamp_seconds(seconds - 2209161600)
    day, clock = F.date_format(moment, "yyyy-MM-dd"), F.date_format(moment, " HH:mm:ss")
    return F.when(serial < 1, F.date_format(moment, "HH:mm:ss")).otherwise(F.concat(day, F.when(clock == " 00:00:00", "").otherwise(clock)))


def clock_text(seconds: Column) -> Column:
    """A duration as [h]:mm:ss."""
    total = F.abs(seconds)
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.floor(total / 3600).cast("string"), F.date_format(F.timestamp_seconds(total), ":mm:ss"))


def cue_time(ms: Column) -> Column:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    hours = F.floor(ms / 3600000)
    return F.concat(F.when(hours < 10, "0").otherwise(""), hours.cast("string"), F.lit(":"), pad(F.floor(ms / 60000) % 60, 2), F.lit(":"), pad(F.floor(ms / 1000) % 60, 2), F.lit("."), pad(ms % 1000, 3))


def iso_duration_seconds(s: Column) -> Column:
    """Seconds of weeks, days and a clock; null with years or months."""
    part = lambda unit: F.coalesce(F.regexp_extract(s, rf"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    clock = F.regexp_extract(s, r"T(.*)$", 1)
    of_clock = lambda unit: F.coalesce(F.regexp_extract(clock, rf"([0-9]+){unit}", 1).try_cast("long"), F.lit(0))
    total = ((part("W") * 7 + part("D")) * 24 + of_clock("H")) * 3600 + of_clock("M") * 60 + of_clock("S")
    return F.when(s.rlike(r"^P[^T]*[0-9](Y|M)"), None).otherwise(total)


def opens_json(s: Column) -> Column:
    """An object with a key or nothing, or an array with a value."""
    return s.rlike(r"""^\s*(\{\s*("|\}|\z)|\[\s*(\]|\{|\[|"|true|false|null|\z|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*(,|\]\s*\z|\z)))""")


def pipe_row(cells: Column) -> Column:
    blank = F.forall(cells, lambda c: c == "")
    return F.when(blank, F.concat(F.lit("|"), F.repeat(F.lit("  |"), F.size(cells)))).otherwise(F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |")))


def escape_cell(s: Column) -> Column:
    """Only what a table cell always needs: backslashes and bars."""
    return F.regexp_replace(s, r"([\\|])", r"\\$1")

"""Scalar text functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.config import DEFAULTS, Settings

#: Characters at which lines end, besides the newline.
_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\u0085  ]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def truthy(c: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def content_hash(raw: Column) -> Column:
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 16)


def newlines(raw: Column) -> Column:
    return F.regexp_replace(raw, "\r\n?", "\n")


def strip_frontmatter(raw: Column) -> Column:
    return F.regexp_replace(raw, "(?s)\\A---\n.*?\n---\n", "")


def slug_of(raw: Column, fallback: Column) -> Column:
    head = F.regexp_extract(raw, "(?s)\\A---\n(.*?)\n---\n", 1)
    return F.coalesce(truthy(strip(F.regexp_extract(head, r"(?dm)^name:\s*(.+)$", 1))), fallback)


def stem_kebab(file: Column) -> Column:
    return F.translate(F.regexp_replace(F.regexp_extract(file, "([^/]*)$", 1), r"\.[^.]*$", ""), "_", "-")


def _after(c: Column, mark: str) -> Column:
    return F.substr(c, F.locate(mark, c) + len(mark))


def _before(c: Column, mark: str) -> Column:
    return F.substr(c, F.lit(1), F.locate(mark, c) - 1)


def strip_related(raw: Column, s: Settings = DEFAULTS) -> Column:
    """Without the generated block, for chunking: the end marker counts after the start only; without either, unchanged."""
    rest = _after(raw, s.related_start)
    post = F.when(rest.contains(s.related_end), _after(rest, s.related_end)).otherwise("")
    joined = F.concat(strip(F.concat(rstrip(_before(raw, s.related_start)), F.lit("\n"), lstrip(post))), F.lit("\n"))
    return F.when(raw.contains(s.related_start) & raw.contains(s.related_end), joined).otherwise(raw)


def remove_block(raw: Column, s: Settings = DEFAULTS) -> Column:
    """Without the generated block, for writing: the end marker counts anywhere; always ends with one newline."""
    pre = F.when(raw.contains(s.related_start), rstrip(_before(raw, s.related_start))).otherwise(raw)
    post = F.when(raw.contains(s.related_start) & raw.contains(s.related_end), strip(_after(raw, s.related_end))).otherwise("")
    return F.concat(rstrip(F.when(post != "", F.concat(pre, F.lit("\n\n"), post)).otherwise(pre)), F.lit("\n"))


def two_decimals(x: Column) -> Column:
    """A double with two decimals, rounded by its binary value as C and Python do (a tie goes to the even digit), where
    format_string rounds the shortest decimal up: 0.285 is under 0.285 and gives 0.28. Numbers over 1.25 aren't split."""
    scaled = F.abs(x) * float(1 << 56)
    whole = F.floor(scaled)
    part, more = whole * 100, (scaled - whole.cast("double")) * 100.0
    digits, lacks = F.shiftright(part, 56), (F.lit(1 << 55) - part.bitwiseAND((1 << 56) - 1)).cast("double")
    up = (more > lacks) | ((more == lacks) & (digits % 2 == 1))
    n = digits + up.cast("long")
    exact = F.format_string("%s%d.%02d", F.when(x < 0, "-").otherwise(""), F.floor(n / 100), n % 100)
    return F.when(F.abs(x) <= 1.25, exact).otherwise(F.format_string("%.2f", x))


def render_block(links: Column, s: Settings = DEFAULTS) -> Column:
    """``links``: array of (slug, score)."""
    line = lambda x: F.concat(F.lit("- [["), x["slug"], F.lit("]] — "), two_decimals(x["score"]))
    return F.array_join(F.concat(F.array(F.lit(s.related_start), F.lit(s.related_heading)), F.transform(links, line), F.array(F.lit(s.related_end))), "\n")


def split_lines(c: Column) -> Column:
    return F.split(F.regexp_replace(c, _BREAKS, "\n"), "\n", -1)


def is_heading(line: Column) -> Column:
    return line.rlike(r"(?d)^#{1,6}\s")


def heading_text(line: Column) -> Column:
    return strip(F.regexp_extract(line, r"(?d)^#{1,6}\s+(.*)$", 1))


def split_pack(text: Column, limit: int) -> Column:
    """Paragraphs packed greedily into pieces of ``limit`` characters, as a fold; a longer paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), lambda p: strip(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("b"))

    def add(acc: Column, p: Column) -> Column:
        full = (acc["b"] != "") & (F.length(acc["b"]) + F.length(p) + 2 > limit)
        grown = F.when(acc["b"] == "", p).otherwise(F.concat(acc["b"], F.lit("\n\n"), p))
        return F.struct(
            F.when(full, F.concat(acc["o"], F.array(acc["b"]))).otherwise(acc["o"]).alias("o"),
            F.when(full, p).otherwise(grown).alias("b"),
        )

    packed = F.aggregate(paragraphs, start, add, lambda acc: F.when(acc["b"] == "", acc["o"]).otherwise(F.concat(acc["o"], F.array(acc["b"]))))
    return F.when(F.length(text) > limit, packed).when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def ws_clip(c: Column, n: int) -> Column:
    """White space collapsed; cut to n characters and an ellipsis."""
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("…"))).otherwise(flat)


def cmd_short(c: Column) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"(?U)\s+", " ")), 1, 80)


def slug_project(c: Column) -> Column:
    return F.coalesce(truthy(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9-]", "-")), F.lit("misc"))


def slug_id(c: Column) -> Column:
    return F.coalesce(truthy(F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")), F.lit("instinct"))


def title_default(slug: Column) -> Column:
    spaced = F.replace(slug, F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substr(spaced, F.lit(2))))


def clamp(c: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_col(lo), F.least(as_col(hi), c))


def fmt_duration(a: Column, b: Column) -> Column:
    """Whole minutes between two ISO timestamps, as hours and minutes from an hour on; ``?`` if either can't be read."""
    micros = lambda c: F.unix_micros(F.try_to_timestamp(c))
    m = F.floor((micros(b) - micros(a)) / 60_000_000)
    shown = F.when(m >= 60, F.concat(F.floor(m / 60).cast("string"), F.lit("ч "), (m % 60).cast("string"), F.lit("м"))).otherwise(F.concat(m.cast("string"), F.lit("м")))
    return F.coalesce(shown, F.lit("?"))


def short_sid(session: Column, file_stem: Column) -> Column:
    return F.substring(F.coalesce(truthy(session), file_stem), 1, 8)


def day(ts: Column) -> Column:
    return F.coalesce(truthy(F.substring(ts, 1, 10)), F.lit("?"))


def parse_confidence(text: Column) -> Column:
    """The first ``confidence:`` anywhere in the text."""
    return truthy(F.regexp_extract(text, r"confidence:\s*([0-9.]+)", 1)).try_cast("double")


def json_greedy(text: Column) -> Column:
    """First opening to last closing brace, if that is JSON; as VARIANT."""
    return F.try_parse_json(truthy(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def path_slug(path: Column) -> Column:
    return F.translate(path, "/", "-")


def unescape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def age_days(mtime: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(mtime)) / F.lit(86_400_000_000.0)

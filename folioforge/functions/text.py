"""Column expressions for text: cleaning stages with their counters, words and lines."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions.plan import bound_batches, let, release_memory

# What the Unicode stage replaces, after NFKC. The last two are removed.
REPLACEMENTS = {
    "ﬁ": "fi", "ﬂ": "fl", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "−": "-",
    "•": "-", "●": "-", "▪": "-", "■": "-", "◦": "-", "►": "-", "➤": "-", "✓": "-", "✔": "-",
    "\u00a0": " ", "\u200b": "", "\ufeff": "",
}
BULLETS = "•●▪■◦►➤✓✔"

_ONE_TO_ONE = {k: v for k, v in REPLACEMENTS.items() if len(v) == 1}
_REMOVED = "".join(k for k, v in REPLACEMENTS.items() if not v)
_WIDE = {k: v for k, v in REPLACEMENTS.items() if len(v) > 1}

#: Bytes of texts that are normalised at once in a worker.
PART_BYTES = 1 << 20


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    release_memory()  # what the batch before left, or a worker grows with the number of its batches
    return pa.concat_arrays([pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()], pa.string()) for part in _parts(texts)])


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about PART_BYTES, so that a worker never holds a whole batch as Python strings; at least one."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < len(texts) or start == 0:
        before = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(sizes.searchsorted(before + PART_BYTES, side="right")))
        yield texts.slice(start, end - start)
        start = end


def nfkc(text: Column | str, spark: SparkSession | None = None) -> Column:
    """NFKC, for which Spark has no built-in function; ASCII texts, on which it changes nothing, stay out of Python.

    ``spark`` is the session that will run it (without it the active one), whose Arrow batches are bounded.
    """
    bound_batches(spark)
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_nfkc(F.when(F.octet_length(text) > F.length(text), text)), text)


def _translated(text: Column, characters: str, by: str = "") -> Column:
    """Single characters replaced or removed. ASCII texts, which hold none but ASCII ones, are not looked through."""
    if any(map(str.isascii, characters)):
        return F.translate(text, characters, by)
    return let(text, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, characters, by)))


def _where(text: Column, found: str, pattern: str, by: str) -> Column:
    """A regular expression's replacements in the texts that hold ``found``, without which it can find nothing."""
    return let(text, lambda t: F.when(F.contains(t, F.lit(found)), F.regexp_replace(t, pattern, by)).otherwise(t))


def replace_symbols(text: Column) -> Column:
    """Quotes, dashes, bullets and odd spaces become plain characters."""
    for old, new in _WIDE.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return _translated(text, "".join(_ONE_TO_ONE) + _REMOVED, "".join(_ONE_TO_ONE.values()))


def _removed(text: Column, characters: str) -> Column:
    return let(text, lambda t: F.length(t) - F.length(_translated(t, characters)))


def count_symbols(text: Column) -> Column:
    return _removed(text, "".join(REPLACEMENTS)).cast("bigint")


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_HYPHEN = r"([A-Za-z])-\n([A-Za-z])"


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "")


def count_controls(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_CONTROL)).cast("bigint")


def unify_line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def count_line_ends(text: Column) -> Column:
    """Line ends that are not a single line feed."""
    return F.regexp_count(text, F.lit(r"\r\n?")).cast("bigint")


def join_hyphens(text: Column) -> Column:
    """Words broken by a hyphen at a line's end; non-overlapping, so a-/b-/c joins only once."""
    return _where(text, "-\n", _HYPHEN, "$1$2")


def count_hyphens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_HYPHEN)).cast("bigint")


def tabs_to_spaces(text: Column) -> Column:
    return F.replace(text, F.lit("\t"), F.lit(" "))


def count_tabs(text: Column) -> Column:
    return _removed(text, "\t").cast("bigint")


def collapse_spaces(text: Column) -> Column:
    return _where(text, "  ", " {2,}", " ")


def count_spaces(text: Column) -> Column:
    """Characters that collapsing spaces removes."""
    return (F.length(text) - F.length(collapse_spaces(text))).cast("bigint")


def bullets_to_dashes(text: Column) -> Column:
    return _translated(text, BULLETS, "-" * len(BULLETS))


def count_bullets(text: Column) -> Column:
    return _removed(text, BULLETS).cast("bigint")


#: White space as str.split sees it, but for the line feed: as characters, and for a character class. Single characters of one
#: byte are looked up in a table; the others are compared one by one, so a range is tested before them that most texts never meet.
_BLANKS = "\t\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = r"[\t\x0B\f\r \x1C\x1D\x1E\x1F\x{85}\x{A0}][\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
_SPACE = rf"[\n{_BLANK}]"
#: A run of anything else: characters of one byte by a table first, then the ranges between the wide blanks.
_NARROW = "".join(rf"\x{{{i:X}}}" for i in range(256) if not chr(i).isspace())
_WORD = rf"[[{_NARROW}][\x{{100}}-\x{{167F}}\x{{1681}}-\x{{1FFF}}\x{{200B}}-\x{{2027}}\x{{202A}}-\x{{202E}}\x{{2030}}-\x{{205E}}\x{{2060}}-\x{{2FFF}}\x{{3001}}-\x{{10FFFF}}]]+"
_ODD_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_LINE_END = r"[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def trim_lines(text: Column) -> Column:
    """No white space at a line's end; all kinds of line borders become line feeds, the last one goes."""
    text = F.regexp_replace(text, r"[\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?+", "\n")
    text = F.regexp_replace(text, rf"[{_BLANK}]++(?=\n|\z)", "")
    return let(text, lambda t: F.when(F.endswith(t, F.lit("\n")), F.regexp_replace(t, r"\n\z", "")).otherwise(t))


def limit_blank_lines(text: Column) -> Column:
    return _where(text, "\n\n\n", r"\n{3,}", "\n\n")


def count_blank_runs(text: Column) -> Column:
    three = F.length(F.replace(text, F.lit("\n\n\n"), F.lit("")))
    return ((F.length(text) - three) / 3).cast("bigint")


def same_length_difference(before: Column, after: Column) -> Column:
    return (F.length(before) - F.length(after)).cast("bigint")


@dataclass(frozen=True)
class CleanerConfig:
    """Which stages run; a stage that is off changes nothing and counts nothing."""

    unicode: bool = True
    controls: bool = True
    line_ends: bool = True
    hyphens: bool = True
    tabs: bool = True
    spaces: bool = True
    bullets: bool = True
    trailing: bool = True
    blank_lines: bool = True


#: (option, counter, counting function, stage), in the order in which they run.
STAGES = [
    ("unicode", "unicode_replacements", count_symbols, replace_symbols),
    ("controls", "control_characters", count_controls, strip_controls),
    ("line_ends", "line_ends", count_line_ends, unify_line_ends),
    ("hyphens", "hyphen_fixes", count_hyphens, join_hyphens),
    ("tabs", "tabs", count_tabs, tabs_to_spaces),
    ("spaces", "spaces_removed", count_spaces, collapse_spaces),
    ("bullets", "bullets", count_bullets, bullets_to_dashes),
    ("trailing", "trailing_removed", None, trim_lines),
    ("blank_lines", "blank_lines_reduced", count_blank_runs, limit_blank_lines),
]
assert [s[0] for s in STAGES] == [f.name for f in fields(CleanerConfig)]


def words(text: Column) -> Column:
    """The words of a text, split at any Unicode white space."""
    return F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD)).cast("bigint")


def line_count(text: Column) -> Column:
    """Lines as splitlines counts them: none in an empty text, and a last line end opens no new line."""
    def count(t: Column) -> Column:
        odd = F.contains(t, F.lit(_ODD_ENDS[0]))
        for c in _ODD_ENDS[1:]:
            odd = odd | F.contains(t, F.lit(c))
        plain = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
        ends = F.when(odd, F.regexp_count(t, F.lit(rf"{_LINE_END}(?:(?<=\r)\n)?+"))).otherwise(plain)
        closed = F.regexp_like(F.right(t, F.lit(1)), F.lit(_LINE_END))
        return F.when(t == "", 0).otherwise(ends + F.when(closed, 0).otherwise(1)).cast("bigint")

    return let(text, count)


WHITE_SPACE = "\n" + _BLANKS


def trim_all(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def present(text: Column) -> Column:
    """The value, or null where it is blank: blank strings stand for missing values."""
    return F.when(F.trim(text) != "", text)


def value_or(text: Column, fallback: str = "—") -> Column:
    return F.coalesce(F.when(trim_all(text) != "", text), F.lit(fallback))


def experience_years(text: Column) -> Column:
    """The first run of digits, or 0."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint"), F.lit(0)).cast("bigint")


def experience_text(total: Column, experience: Column, fallback_to_roles: bool = True) -> Column:
    """The stated experience; without one the number of roles, or nothing."""
    roles = F.when(F.coalesce(F.size(experience), F.lit(0)) > 0, F.concat(F.size(experience).cast("string"), F.lit(" roles"))).otherwise("0 years")
    return F.coalesce(F.nullif(total, F.lit("")), roles if fallback_to_roles else F.lit(""))


def experience_range(years: Column) -> Column:
    return F.when(years <= 2, "0-2").when(years <= 5, "2-5").when(years <= 10, "5-10").otherwise("10+")


def initials(name: Column) -> Column:
    """First letters of the first two words in upper case; F for a missing name."""
    parts = F.slice(F.split(name, r"\s+"), 1, 2)
    letters = F.upper(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))
    return F.when(F.coalesce(name, F.lit("")) == "", "F").otherwise(letters)


def paper_count(journal: Column, conference: Column) -> Column:
    return F.coalesce(journal, F.lit(0)) + F.coalesce(conference, F.lit(0))


def profile_id(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"(?i)\.json$", "")


def source_path(identifier: Column, base: str = "resumes/") -> Column:
    """Where a profile's source file is expected: the first of the three kinds, unconditionally."""
    return F.concat(F.lit(base), identifier, F.lit(".pdf"))

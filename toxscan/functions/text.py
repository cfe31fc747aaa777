"""Text cleaning and token functions as built-in column expressions (no Python UDF).

Every function returns a ``Column`` so that Catalyst keeps it inside whole-stage code generation
and pushes it next to the scan. The regular expressions are plain Java patterns; the same pattern
strings are valid RE2, which is what the DuckDB oracle uses.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values (they must equal the reference for equal results).
#
# Characters the cleaner keeps, besides all of ASCII (U+0000-U+007F) and the range ㄱ-힣
# (U+3131-U+D7A3), in the order the reference lists them:
KEEP_CHARS = " .,?!/@$%~％·∼()"
KEEP_RANGES = ((0x0000, 0x007F), (0x3131, 0xD7A3))
# Emoji are taken as these fixed ranges: the code points with the Unicode property Emoji that are not ASCII, blocks
# of symbols whole, and what joins or varies them (joiner, variation selector 16, keycap, tags).
EMOJI_RANGES = (
    (0x00A9, 0x00A9), (0x00AE, 0x00AE), (0x200D, 0x200D), (0x203C, 0x203C), (0x2049, 0x2049), (0x20E3, 0x20E3),
    (0x2122, 0x2122), (0x2139, 0x2139), (0x2194, 0x2199), (0x21A9, 0x21AA), (0x231A, 0x231B), (0x2328, 0x2328),
    (0x23CF, 0x23CF), (0x23E9, 0x23F3), (0x23F8, 0x23FA), (0x24C2, 0x24C2), (0x25AA, 0x25AB), (0x25B6, 0x25B6),
    (0x25C0, 0x25C0), (0x25FB, 0x25FE), (0x2600, 0x27BF), (0x2934, 0x2935), (0x2B05, 0x2B07), (0x2B1B, 0x2B1C),
    (0x2B50, 0x2B50), (0x2B55, 0x2B55), (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299),
    (0xFE0F, 0xFE0F), (0x1F004, 0x1F004), (0x1F0CF, 0x1F0CF), (0x1F170, 0x1F171), (0x1F17E, 0x1F17F),
    (0x1F18E, 0x1F18E), (0x1F191, 0x1F19A), (0x1F1E6, 0x1F1FF), (0x1F201, 0x1F202), (0x1F21A, 0x1F21A),
    (0x1F22F, 0x1F22F), (0x1F232, 0x1F23A), (0x1F250, 0x1F251), (0x1F300, 0x1FAFF), (0xE0020, 0xE007F),
)
# Word characters among those the cleaner keeps: digits, Latin letters, underscore, Hangul letters and syllables,
# and the ideographs of the kept range.
WORD_RANGES = ((0x30, 0x39), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0x3131, 0x318E), (0x3400, 0x4DBF),
               (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))
# URL pattern removed after the allowlist step:
URL_PATTERN = (
    r"https?:\/\/(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
    r"([-a-zA-Z0-9()@:%_\+.~#?&//=]*)"
)
# Whitespace as Python's str.strip() sees it among the characters that survive the allowlist:
# tab, newline, vertical tab, form feed, carriage return, U+001C-U+001F and space.
WHITESPACE_CLASS = r"\t-\r\x1c-\x20"
# Unicode whitespace that str.rstrip() removes (used by the line-set reader, which sees raw text):
UNICODE_WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Text used for a missing document, as str() of a missing pandas value prints it:
NULL_TEXT = "nan"
# Mask character written once per character of a masked token:
MASK_CHAR = "*"
# ---------------------------------------------------------------------------------------------


def _cp(c: int) -> str:
    return "\\x{%X}" % c


def _ranges_to_class(ranges) -> str:
    return "".join(_cp(a) if a == b else f"{_cp(a)}-{_cp(b)}" for a, b in ranges)


def _compress(codepoints) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(set(codepoints)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


@lru_cache(maxsize=1)
def kept_ranges() -> tuple[tuple[int, int], ...]:
    cps = {ord(ch) for ch in KEEP_CHARS}
    for a, b in KEEP_RANGES + EMOJI_RANGES:
        cps.update(range(a, b + 1))
    return tuple(_compress(cps))


def word_ranges() -> tuple[tuple[int, int], ...]:
    """The fixed word class: the same under every Python version, in Spark and in the oracle."""
    return WORD_RANGES


@lru_cache(maxsize=1)
def not_kept_pattern() -> str:
    return f"[^{_ranges_to_class(kept_ranges())}]+"


@lru_cache(maxsize=1)
def word_class() -> str:
    return _ranges_to_class(word_ranges())


@lru_cache(maxsize=1)
def repeat_pattern() -> str:
    return f"([{word_class()}])\\1{{2,}}"


@lru_cache(maxsize=1)
def token_pattern() -> str:
    """A token is a run of word characters or one other non-space character (plain form; the
    DuckDB oracle uses it)."""
    wc = word_class()
    return f"[{wc}]+|[^{wc}{WHITESPACE_CLASS}]"


# Java evaluates a character class of many ranges as a chain of range tests, paid in full by every
# character outside it. The Spark forms below are equivalent but test the few ASCII ranges first
# and reach the long non-ASCII class (largest ranges first) only through a class intersection
# whose first, one-range operand rejects ASCII at once.


@lru_cache(maxsize=1)
def _ascii_word_class() -> str:
    return _ranges_to_class([(a, b) for a, b in word_ranges() if b < 0x80])


@lru_cache(maxsize=1)
def _wide_word_class() -> str:
    wide = [(a, b) for a, b in word_ranges() if a >= 0x80]
    return _ranges_to_class(sorted(wide, key=lambda r: (r[0] - r[1], r[0])))


_NON_ASCII = "[^\\x{0}-\\x{7F}]"


@lru_cache(maxsize=1)
def _wide_word_char() -> str:
    return f"[{_NON_ASCII}&&[{_wide_word_class()}]]"


@lru_cache(maxsize=1)
def repeat_patterns_fast() -> tuple[str, str]:
    """The repeat collapse as two passes: ASCII runs, then non-ASCII runs. A run is one repeated
    character, so the passes do not interact and equal the one-pass ``repeat_pattern``."""
    return (f"([{_ascii_word_class()}])\\1{{2,}}", f"({_wide_word_char()})\\1{{2,}}")


@lru_cache(maxsize=1)
def token_pattern_fast() -> str:
    word = f"(?:[{_ascii_word_class()}]|{_wide_word_char()})"
    other = f"[[^{_ascii_word_class()}{WHITESPACE_CLASS}]&&[^{_wide_word_class()}]]"
    return f"{word}+|{other}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_as_text(c) -> Column:
    """A missing text becomes the literal ``nan``."""
    return F.coalesce(_col(c), F.lit(NULL_TEXT))


def allowlist_chars(c) -> Column:
    """Each maximal run of characters outside the allowlist becomes one space."""
    return F.regexp_replace(_col(c), not_kept_pattern(), " ")


def strip_urls(c) -> Column:
    """Remove http(s) URLs."""
    return F.regexp_replace(_col(c), URL_PATTERN, "")


def trim_text(c) -> Column:
    """Strip whitespace at both ends (``trim`` alone only strips spaces)."""
    return F.regexp_replace(_col(c), f"^[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+\\z", "")


def collapse_repeats(c, num_repeats: int = 2) -> Column:
    """T4: a word character repeated three or more times is written ``num_repeats`` times; then
    whitespace runs become one space and the ends are stripped."""
    out = _col(c)
    if num_repeats > 0:
        for pattern in repeat_patterns_fast():
            out = F.regexp_replace(out, pattern, "$1" * num_repeats)
    # Once every whitespace run is one space, only a space can remain at either end, so the
    # built-in trim (spaces only, no regular expression) is exact here.
    return F.trim(F.regexp_replace(out, f"[{WHITESPACE_CLASS}]+", " "))


def clean_text(c, null_text: bool = True, num_repeats: int = 2) -> Column:
    """T5: allowlist, URL removal, trim, repeat collapse, in that order.

    The separate trim (T3) is not run here: the repeat collapse only touches word characters, and
    the collapse ends with whitespace runs made one space and both ends trimmed, which gives the
    same text. DuckDB runs every step (the oracle checks the equality)."""
    out = null_as_text(c) if null_text else _col(c)
    return collapse_repeats(strip_urls(allowlist_chars(out)), num_repeats)


def tokenize(c) -> Column:
    """Lower case, then runs of word characters and single other characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(token_pattern_fast()), 0)


def token_pieces(cleaned) -> Column:
    """Tokens of a cleaned text, each with the one space before it when there is one. Joining the
    pieces with '' gives the cleaned text back; ``lower`` of a piece without its space is the token
    ``tokenize`` gives (case mapping keeps word characters word characters)."""
    return F.regexp_extract_all(_col(cleaned), F.lit(f" ?(?:{token_pattern_fast()})"), 0)


def piece_token(piece) -> Column:
    return F.lower(F.regexp_replace(_col(piece), "^ ", ""))


def mask_token(c) -> Column:
    """One mask character per character of the token once ``#`` and spaces are removed."""
    bare = F.regexp_replace(_col(c), "[# ]", "")
    return F.repeat(F.lit(MASK_CHAR), F.length(bare))


def format_report(label, pred, p0, p1) -> Column:
    """The per-sentence report line."""
    return F.format_string(
        "label: %d,\tpred: %d,\tprobability: %.2f\t%.2f", _col(label), _col(pred), _col(p0), _col(p1)
    )


def lines(c) -> Column:
    """Lines of a text as a file reader yields them: split on \\n, \\r\\n or \\r, no empty element
    after a final line break, no line at all for empty text."""
    body = F.regexp_replace(_col(c), r"(\r\n|\r|\n)\z", "")
    return F.when(_col(c) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n"))


def rstrip_unicode(c) -> Column:
    """Right strip of all Unicode whitespace, as ``str.rstrip()``."""
    return F.regexp_replace(_col(c), f"[{UNICODE_WHITESPACE_CLASS}]+\\z", "")

"""String expressions, written as SQL text so that a whole job is one ``select``.

Every function takes and returns SQL text; ``F.expr`` turns the result into a column.
"""

from __future__ import annotations

# The characters that count as white space when a text is trimmed.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
    0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, _SPACE_POINTS))
_SPACE_CHARS = "".join(f"\\u{point:04X}" for point in _SPACE_POINTS)


def strip(text: str) -> str:
    """Trim every kind of white space, not only blanks."""
    return f"btrim({text}, '{_SPACE_CHARS}')"


def collapse_space(text: str) -> str:
    """Runs of white space become one blank, none at the ends."""
    return strip(f"regexp_replace({text}, r'{SPACE}+', ' ')")


def percent_decode(text: str) -> str:
    """Decode %XX as UTF-8; ``+`` and malformed escapes stay as they are."""
    return f"url_decode(regexp_replace(replace({text}, '+', '%2B'), '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def percent_decode_stable(text: str, rounds: int = 5) -> str:
    """Decode nested percent-encoding, at most ``rounds`` times."""
    decoded = text
    for _ in range(rounds):
        decoded = percent_decode(decoded)
    return f"if(contains({text}, '%'), {decoded}, {text})"


def form_decode(text: str) -> str:
    """Decode a query key or value: ``+`` is a blank, then %XX."""
    return percent_decode(f"replace({text}, '+', ' ')")


def form_encode(text: str) -> str:
    """Percent-encode everything but unreserved characters."""
    return f"replace(replace(replace(url_encode({text}), '+', '%20'), '*', '%2A'), '%7E', '~')"

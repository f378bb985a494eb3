r"""Split patterns in Java syntax, following the documented regular expressions.

Java's ``\s`` is ASCII only and its ``$`` matches before a last newline, hence the
spelled-out white space and ``\z``.
"""


def _kinds(names: str) -> str:
    """Character class of the named Unicode categories."""
    return "[" + "".join(rf"\p{{{n}}}" for n in names.split()) + "]"


WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LETTER, NUMBER = r"\p{L}", r"\p{N}"
SUFFIX = "(?i:'(?:" + "|".join("s t re ve m ll d".split()) + "))"
BLANKS = rf"[{WHITE}]*[\r\n]+|[{WHITE}]+\z|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

LEAD = rf"[^\r\n{LETTER}{NUMBER}]?"
UPPER, LOWER = _kinds("Lu Lt Lm Lo M"), _kinds("Ll Lm Lo M")


def _marks(tail: str) -> str:
    """Numbers by threes, then marks with a blank before and any of `tail` behind."""
    return rf"{NUMBER}{{1,3}}| ?[^{WHITE}{LETTER}{NUMBER}]+[{tail}]*"


CL = "|".join((SUFFIX, f"{LEAD}{LETTER}+", _marks(r"\r\n"), BLANKS))
O2 = "|".join((f"{LEAD}{UPPER}*{LOWER}+{SUFFIX}?", f"{LEAD}{UPPER}+{LOWER}*{SUFFIX}?", _marks(r"\r\n/"), BLANKS))
NAMED = {"cl": CL, "o2": O2}

"""Four ways to fold Arabic text, which differ on purpose; see also ``cleaning.normalize_letters``."""

from __future__ import annotations

from quillspark.functions import patterns as P
from quillspark.functions.dialect import WS, Dialect


def fold_index(d: Dialect, x: str) -> str:
    """As stored text is folded: alef, teh marbuta, alef maksura; no tatweel, no marks."""
    return d.replace(d.translate(x, "أإآةى", "اااهي"), "[ـ\\x{064B}-\\x{0652}\\x{0670}]", "")


def fold_query(d: Dialect, x: str) -> str:
    """As search queries are folded: also hamza carriers, underscores and white space."""
    x = d.replace(d.translate(x, "أإآةىؤئ", "اااهيءء"), "[\\x{064B}-\\x{065F}ـ]", "")
    return d.trim(d.single_spaced(d.translate(x, "_", " ")))


def fold_token(d: Dialect, x: str) -> str:
    """As words are folded for tags: hamza carriers become letters, case is dropped, tatweel stays."""
    x = d.replace(x, TOKEN_MARKS, "")
    return d.trim(f"lower({d.translate(x, 'إأآىؤئة', 'ااايويه')})")


#: Fixed value: marks that the folding of tags removes.
TOKEN_MARKS = "[\\x{0610}-\\x{061A}\\x{064B}-\\x{0652}\\x{0670}]"


def stop_words(d: Dialect) -> str:
    return ", ".join(d.lit(w) for w in P.STOP_WORDS)


def tokens(d: Dialect, x: str) -> str:
    """The words of a text for tagging: folded, of two characters or more, no stop words."""
    return d.filter(all_tokens(d, x), "w", counts(d, "w"))


def counts(d: Dialect, word: str) -> str:
    """Whether a folded word counts."""
    return f"length({word}) >= 2 and {word} not in ({stop_words(d)})"


def all_tokens(d: Dialect, x: str) -> str:
    """The words of a text, folded. In Spark all at once: words joined by spaces, which folding leaves alone."""
    if d.duck:
        cleaned = d.replace(x, rf"[^\p{{L}}\p{{N}}{WS[1:-1]}]", " ")
        return d.map(f"regexp_split_to_array({cleaned}, {d.lit(WS + '+')})", "w", fold_token(d, "w"))
    return f"split({fold_token(d, d.join(d.extract_all(x, '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+'), ' '))}, ' ')"

"""The text-cleaning passes and their composition.

Each pass is SQL over built-in functions, given a dialect and the SQL of a text
(see ``dialect``), so that Catalyst sees all of it. Three steps can't be said
in built-in functions at a sane cost: Unicode compatibility composition (Spark
has none), merging broken lines and dropping near-equal paragraphs (folds whose
accumulator would be copied at every step). They are Arrow functions, text by
text. The composition of all passes is one such function: the passes have a
second form there (``TEXT_PASSES``), of the same patterns, and tests hold each
to its SQL.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields
from itertools import pairwise, repeat
from operator import eq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import patterns as P
from quillspark.functions.dialect import NOT_WS, SPARK, WHITE, WS, Dialect


def strip_controls(d: Dialect, x: str) -> str:
    return d.replace(x, P.CONTROLS, "")


def normalize_letters(d: Dialect, x: str) -> str:
    """Variants of alef, yaa and kaf become one; a detached article is joined to its word; Hijri dates lose OCR debris."""
    x = d.translate(x, P.ALEF + P.YAA + P.KAF, "ا" * len(P.ALEF) + "ي" * len(P.YAA) + "ك" * len(P.KAF))
    if d.duck:
        x = d.replace(x, rf"(^|[^{P.ARABIC_RANGES}])ال{WS}+({P.ARABIC})", "$1ال$2")
    else:
        x = d.replace(x, rf"ال(?<!{P.ARABIC}ال){WS}++({P.ARABIC})", "ال$1")
    edge = rf"[)\](]|(?<![)\]({WS[1:]})"
    sign = d.either(rf"[)\](]?{WS}*©{WS}*(\d+{WS}*ه)", rf"(?:{edge}){WS}*+©{WS}*+(\d++{WS}*+ه)")
    x = d.when_it_has(x, "©", lambda g: d.replace(g, sign, "(ت $1"))
    return d.replace(x, d.either(rf"(\d+){WS}*ه{WS}*[)\]]", rf"(?<!\d)(\d++){WS}*+ه{WS}*+[)\]]"), "$1 هـ)")


def remove_tashkeel(d: Dialect, x: str) -> str:
    return d.replace(x, P.TASHKEEL, "")


def remove_tatweel(d: Dialect, x: str) -> str:
    return d.replace(x, "ـ", "")


def normalize_digits(d: Dialect, x: str) -> str:
    return d.translate(x, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def normalize_whitespace(d: Dialect, x: str) -> str:
    x = d.chain(x, (("\r\n?", "\n"), (d.either(r"[ \t]+", r"[ \t]{2,}+|\t"), " "), (d.either(r"\n{3,}", r"\n{3,}+"), "\n\n")))
    return d.trim(d.lines(x, "l", d.trim("l")))


def remove_broken_html(d: Dialect, x: str) -> str:
    x = d.when_it_has(x, "<", lambda g: d.chain(g, P.HTML_TAGS))
    return d.replace(x, r"\n{3,}", "\n\n")


def remove_ascii_noise(d: Dialect, x: str) -> str:
    """Words of one or two Latin letters go from lines that are mostly Arabic."""
    word = rf"\b[a-zA-Z]{{1,2}}\b" if d.duck else r"(?<![A-Za-z0-9_])[a-zA-Z]{1,2}(?![A-Za-z0-9_])"
    cleaned = d.trim(d.chain("t", ((word, ""), (f"{WS}{{2,}}", " "))))
    mostly = f"{d.count_class('t', P.ARABIC)} > 0.4 * length({d.solid('t')})"
    skip = f"t = '' or {d.starts('t', '#')} or {d.starts('t', '---')}"
    return d.lines(x, "l", d.let(d.trim("l"), "t", f"case when {skip} then l when {mostly} then {cleaned} else l end"))


#: An edge of a word of ASCII letters, digits and underscores, whatever the engine's notion of \\b.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def remove_repeated_tokens(d: Dialect, x: str) -> str:
    """A token four times or more in a row, with ASCII edges, stays once. Back references: not in DuckDB.

    The second and third are whole, so texts in which no word comes twice at once, with a third time begun, are left alone.
    The last may be the start of a longer word. Runs of copies are possessive: a run that can be given back takes a frame of Java's
    stack for each copy, and a text of thousands would end the executor.
    """
    hint = d.matches("g", rf"(?<={WS})({NOT_WS}++){WS}++\1{WS}++\1")
    copy = rf"{WS}++\1"
    whole, begun = rf"(?:{copy}(?!{NOT_WS}))", rf"{copy}(?={NOT_WS})"
    repeated = rf"{EDGE}({NOT_WS}++)(?:{whole}{{2,}}+{begun}{EDGE}|{whole}{{3,}}+{EDGE})"
    return d.let(x, "g", f"if({hint}, {d.replace('g', repeated, '$1')}, g)")


def remove_garbage_symbols(d: Dialect, x: str, confidence: str | None = None) -> str:
    """Lines that are mostly symbols become empty; ``confidence`` is SQL of a double, or None."""
    threshold = "0.7" if confidence is None else f"(0.6 + (1.0 - {confidence}) * 0.2)"
    real = d.count_class("c", f"[{P.ARABIC_RANGES}a-zA-Z0-9]")
    noisy = d.let(real, "r", f"length(c) > 5 and length(c) - r > {threshold} * length(c) and r < 2")
    only = d.matches("t", rf"^(?:[？！.،\-]|{WS}){{5,}}\z")
    body = d.let(d.solid("t"), "c", f"case when t = '' or length(c) < 2 then l when ({noisy}) or {only} then '' else l end")
    return d.lines(x, "l", d.let(d.trim("l"), "t", body))


def normalize_punctuation(d: Dialect, x: str) -> str:
    for mark, pattern, to in P.PUNCTUATION:
        if not d.duck:  # what follows an Arabic letter is looked for from the mark, not from each letter
            pattern = re.sub(r"^\((\[.+?\])(\[.+?\])\*\)(.+)$", r"(?<=\1)(\2*+)\3", pattern)
        x = d.when_it_has(x, mark, lambda g, p=pattern, to=to: d.replace(g, p, to)) if mark else d.replace(x, pattern, to)
    return x


def remove_isolated_fragments(d: Dialect, x: str, confidence: str | None = None) -> str:
    """Very short lines of symbols alone become empty."""
    least = "3" if confidence is None else f"case when {confidence} > 0.8 then 2 else 3 end"
    marked = " or ".join(d.starts("t", p) for p in ("#", "- ", "> "))
    lone = f"length(t) <= {least} and not {d.matches('t', f'[{P.ARABIC_RANGES}a-zA-Z0-9]')}"
    return d.lines(x, "l", d.let(d.trim("l"), "t", f"case when t = '' or {marked} then l when {lone} then '' else l end"))


def collapse_repeated_words(d: Dialect, x: str) -> str:
    """An Arabic word, or a phrase of two to four, three times or more in a row stays once. Back references: not in DuckDB.

    What follows a run of letters must be white space, so runs are possessive: giving letters back could not help, only cost time.
    So are runs of copies, which would take a frame of Java's stack for each.
    """
    letter = r"[\x{0600}-\x{06FF}]"
    word, phrase = rf"({letter}{{2,}}+)", rf"((?:{letter}++{WS}++){{1,3}}{letter}++)"
    # of three in a row, the second starts after white space and is followed by itself; of a phrase, the first's words but its first
    # are whole too, and so are the third's but its last: looked for at starts of words alone
    met = rf"(?<={WS})((?:{letter}++{WS}++){{0,2}}{letter}++){WS}++({letter}++{WS}++)\1{WS}++\2\1"
    for repeated, sign in ((word, rf"(?<={WS}){word}{WS}++\1"), (phrase, met)):
        hint = d.matches("g", sign)
        x = d.let(x, "g", f"if({hint}, {d.replace('g', rf'{repeated}({WS}++' + chr(92) + '1){2,}+', '$1')}, g)")
    return x


def _headed(d: Dialect, t: str) -> str:
    return " or ".join(d.starts(t, p) for p in ("## ", "# ", "### "))


def _any(d: Dialect, t: str, *tests: str) -> str:
    return " or ".join(d.matches(t, p) for p in tests)


def detect_headings(d: Dialect, x: str) -> str:
    major = _any(d, "t", P.HEADING_MAJOR, P.HEADING_NUMBERED_ANY, P.HEADING_PAREN, P.HEADING_EXAMPLE, P.HEADING_PARTICIPATION)
    minor = _any(d, "t", P.HEADING_SUB, P.HEADING_ORDINAL)
    body = f"case when t = '' or {_headed(d, 't')} then l when {major} then concat('## ', t) when {minor} then concat('### ', t) else l end"
    return d.lines(x, "l", d.let(d.trim("l"), "t", body))


def detect_late_headings(d: Dialect, x: str) -> str:
    """As :func:`detect_headings`, after lines are merged: fewer patterns."""
    major = _any(d, "t", P.HEADING_MAJOR, P.HEADING_PAREN, P.HEADING_NUMBERED, P.HEADING_EXAMPLE, P.HEADING_PARTICIPATION)
    body = f"case when t = '' or {_headed(d, 't')} then l when {major} then concat('## ', t) when {d.matches('t', P.HEADING_SUB)} then concat('### ', t) else l end"
    return d.lines(x, "l", d.let(d.trim("l"), "t", body))


def remove_page_noise(d: Dialect, x: str) -> str:
    """Drops lines that are page numbers, bullets, digits and separators, or short capitals."""
    noise = _any(d, "t", *P.PAGE_NUMBERS, r"^[•·\-–—*]+\z", rf"^(?:[\d\-–—|/\\]|{WS})+\z")
    capitals = f"({d.matches('t', rf'^(?:[A-Z]|{WS}){{3,}}' + chr(92) + 'z')} and length(t) < 20)"
    return d.keep_lines(x, "l", d.let(d.trim("l"), "t", f"t = '' or not ({noise} or {capitals})"))


def final_cleanup(d: Dialect, x: str) -> str:
    """Joins letters parted by exclamation marks, strips debris at both ends of lines, and drops blank, decorative and garbled lines."""
    joined = d.when_it_has("l", "!", lambda g: d.replace(g, r"([\x{0600}-\x{06FF}])!+([\x{0600}-\x{06FF}])", "$1$2"))
    marked = f"{_headed(d, 'j')} or {d.starts('j', '- ')} or {d.starts('j', '> ')} or {d.matches('j', P.BULLET)}"
    body = f"case when {marked} then j else {d.replace('j', r'^[^' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}A-Za-z0-9_]+', '')} end"
    cut = d.replace(f"({body})", P.TRAILING_JUNK, "") if d.duck else d.let(f"({body})", "b", f"if({d.matches('right(b, 1)', P.JUNK)}, {d.replace('b', P.BEFORE_JUNK, '$1')}, b)")
    lines = d.map(d.split(x, "\n"), "l", d.let(joined, "j", cut))
    known = d.count_class("c", f"[{P.KNOWN}]")
    decor = d.matches("t", rf"^(?:[\-–—•·*]|{WS})+\z")
    good = d.let(d.solid("t"), "c", f"length(c) < 3 or {known} >= {1 - P.GARBAGE_THRESHOLD} * length(c)")
    return d.join(d.filter(lines, "l", d.let(d.trim("l"), "t", f"case when t = '' or {decor} then false else {good} end")), "\n")


def similarity(d: Dialect, a: str, b: str) -> str:
    """Jaccard similarity of the sets of words: equal texts 1, an empty one 0."""
    if d.duck:
        parts = lambda x: f"regexp_split_to_array({x}, {d.lit(WS + '+')})"
        share = f"cast(len(list_distinct(list_intersect({parts(a)}, {parts(b)}))) as double) / len(list_distinct(list_concat({parts(a)}, {parts(b)})))"
    else:  # each text is split once
        words = lambda x: f"array_distinct(split({d.spaces(x)}, ' +', -1))"
        share = d.let("size(array_intersect(p, q))", "n", "cast(n as double) / (size(p) + size(q) - n)")
        share = d.let(words(a), "p", d.let(words(b), "q", share))
    return f"case when {a} = {b} then cast(1 as double) when {a} = '' or {b} = '' then cast(0 as double) else {share} end"


# --- steps that are Python functions of one text ---

def _compiled(pattern: str) -> re.Pattern:
    pattern = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern).replace("\\z", "\\Z")
    return re.compile(pattern, re.ASCII)  # digits and case as Java has them


_SPACE, _NO_SPACE = _compiled(f"{WS}+"), _compiled(WS.replace(" ", ""))
_BULLET, _LINE_START = _compiled(P.BULLET), _compiled(P.LINE_START)
_LAST_WORD, _ARABIC = _compiled(rf"{WS}(?:{P.LINE_END_WORDS})\z"), _compiled(P.ARABIC)
_LAST_LENGTH = 1 + max(map(len, P.LINE_END_WORDS.split("|")))
LISTED = rf"^\[?{WS}*[0-9]+{WS}*\]?(?:[\-.)]|{WS})|^\([0-9]+\)|^[¹²³]"
_LISTED = _compiled(LISTED)
_SENTENCE_END = tuple(".?!،؟")
SHORT_LINE = 40


def compose(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _goes_on(line: str) -> bool:
    """Whether a trimmed line ends with a word that asks for more, after an Arabic one."""
    last = _LAST_WORD.search(line, max(0, len(line) - _LAST_LENGTH))
    return bool(last and _ARABIC.match(line[: last.start()].rstrip(WHITE)[-1:]))


def merge_lines(text: str) -> str:
    """Rejoins lines that a page layout has broken.

    A line stands alone if it is empty, a heading, a bullet or a numbered item. Others are gathered until one completes
    the sentence: it ends with punctuation, or is short and neither it nor the line before asks for a continuation.
    """
    done: list[str] = []
    open_lines: list[str] = []
    carried_on = False

    def close() -> None:
        if open_lines:
            done.append(" ".join(open_lines))
            open_lines.clear()

    for line in text.split("\n"):
        line = line.strip(WHITE)
        if not line or line.startswith(("## ", "# ", "### ")) or _BULLET.match(line) or _LISTED.match(line):
            close()
            done.append(line)
            carried_on = False
            continue
        free = not (_LINE_START.match(line) or carried_on)
        carried_on = _goes_on(line)
        open_lines.append(line)
        if free and (line.endswith(_SENTENCE_END) or len(line) < SHORT_LINE and not carried_on):
            close()
    close()
    return "\n".join(done)


def _wide(text: str) -> bool:
    """Whether there may be white space other than single spaces."""
    return "  " in text or _NO_SPACE.search(text) is not None


def jaccard(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    one, other = set(_SPACE.split(a)), set(_SPACE.split(b))
    return len(one & other) / len(one | other)


def drop_near_paragraphs(text: str) -> str:
    """Drops a paragraph of over 20 characters that shares over 0.7 of its words with the last one kept."""
    kept, last = [], ""
    for paragraph in text.split("\n\n"):
        plain = paragraph.strip(WHITE).replace("\n", " ")
        plain = _SPACE.sub(" ", plain) if _wide(plain) else plain
        if last and len(plain) > 20 and jaccard(plain, last) > 0.7:
            continue
        kept.append(paragraph)
        last = plain
    return "\n\n".join(kept)


def _each(fn):
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn, na_action="ignore")

    return run


compose_udf = F.pandas_udf(_each(compose), T.StringType())
merge_lines_udf = F.pandas_udf(_each(merge_lines), T.StringType())
drop_near_paragraphs_udf = F.pandas_udf(_each(drop_near_paragraphs), T.StringType())


# --- the passes as functions of one text, for the composition ---

_LETTER = r"[\x{0600}-\x{06FF}]"
_REAL = _compiled(f"[{P.ARABIC_RANGES}a-zA-Z0-9]")
_CONTROLS, _TASHKEEL, _ARABIC_RUN = _compiled(P.CONTROLS), _compiled(P.TASHKEEL), _compiled(P.ARABIC + "++")
_HEADINGS = ("## ", "# ", "### ")


def _one_of(*patterns: str) -> re.Pattern:
    return _compiled("|".join(f"(?:{p})" for p in patterns))


def _solid_length(text: str) -> int:
    return len(text) - text.count(" ") - len(_NO_SPACE.findall(text))


def _words(text: str) -> list[str]:
    text = text.replace("\n", " ")
    return _SPACE.split(text) if _NO_SPACE.search(text) else [word for word in text.split(" ") if word]


def _by_line(fn):
    """The pass that does ``fn`` to each line, given the line and its trimmed form."""

    def run(text: str, *more) -> str:
        return "\n".join([fn(line, line.strip(WHITE), *more) for line in text.split("\n")])

    return run


_ARTICLE = _compiled(rf"ال(?<!{P.ARABIC}ال){WS}++({P.ARABIC})")
_SIGN = _compiled(rf"(?:[)\](]|(?<![)\]({WS[1:]})){WS}*+©{WS}*+(\d++{WS}*+ه)")
_HIJRI, _HIJRI_END = _compiled(rf"(?<!\d)(\d++){WS}*+ه{WS}*+[)\]]"), _compiled(rf"ه{WS}*+[)\]]")


def _letters(text: str) -> str:
    for variants, plain in ((P.ALEF, "ا"), (P.YAA, "ي"), (P.KAF, "ك")):
        for variant in variants:
            text = text.replace(variant, plain)
    text = _ARTICLE.sub(r"ال\1", text)
    if "©" in text:
        text = _SIGN.sub(r"(ت \1", text)
    return _HIJRI.sub(r"\1 هـ)", text) if _HIJRI_END.search(text) else text


_BLANKS, _BREAKS = re.compile(r"[ \t]{2,}+|\t"), re.compile(r"\n{3,}+")


def _whitespace(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "  " in text or "\t" in text:
        text = _BLANKS.sub(" ", text)
    text = _BREAKS.sub("\n\n", text) if "\n\n\n" in text else text
    return "\n".join([line.strip(WHITE) for line in text.split("\n")]).strip(WHITE)


_TAGS = [(_compiled(pattern), to) for pattern, to in P.HTML_TAGS]


def _broken_html(text: str) -> str:
    if "<" in text:
        for tag, to in _TAGS:
            text = tag.sub(to, text)
    return _BREAKS.sub("\n\n", text) if "\n\n\n" in text else text


# the look-behind follows the first letter, so that the search goes from letter to letter
_SHORT_WORD = re.compile(r"[a-zA-Z](?<![A-Za-z0-9_][a-zA-Z])[a-zA-Z]?(?![A-Za-z0-9_])")
_WIDE = _compiled(f"{WS}{WS}+")


@_by_line
def _ascii_noise(line: str, t: str) -> str:
    if not t or t.startswith(("#", "---")) or t == line and not _SHORT_WORD.search(t) and not _wide(t):
        return line
    arabic = len(t) - len(_ARABIC_RUN.sub("", t))
    return _WIDE.sub(" ", _SHORT_WORD.sub("", t)).strip(WHITE) if 10 * arabic > 4 * _solid_length(t) else line


#: What is repeated, from its first copy, and the sign by which the second copy is known: it is a whole word, and others follow.
_REPEATED_TOKEN = _compiled(rf"{EDGE}({NOT_WS}++)({WS}++\1){{3,}}{EDGE}")
_TOKEN_SIGN = _compiled(rf"{WS}({NOT_WS}++)(?={WS}++\1{WS}++\1)")
_REPEATED_WORD = _compiled(rf"({_LETTER}{{2,}}+)({WS}++\1){{2,}}")
_WORD_SIGN = _compiled(rf"{WS}({_LETTER}{{2,}}+)(?={WS}++\1)")
_REPEATED_PHRASE = _compiled(rf"((?:{_LETTER}++{WS}++){{1,3}}{_LETTER}++)({WS}++\1){{2,}}")


#: Of two to four words: the second copy of the first word, between copies of the others.
_PHRASE_SIGNS = [_compiled(rf"{WS}(?=((?:{_LETTER}++{WS}++){{{k - 2}}}{_LETTER}++){WS}++({_LETTER}++{WS}++)\1{WS}++\2)") for k in (2, 3, 4)]


def _collapsed(text: str, starts: Iterable[int], repeated: re.Pattern) -> str:
    """As ``repeated.sub(r"\\1", text)``, tried only where the first copy must begin, ascending: the second copy's words are whole, so
    they tell the places."""
    out, at = [], 0
    for start in starts:
        if start >= at and (found := repeated.match(text, start)):
            out += [text[at:start], found[1]]
            at = found.end()
    return "".join([*out, text[at:]]) if out else text


def _first_copies(text: str, sign: re.Pattern) -> Iterator[int]:
    for second in sign.finditer(text):
        end = second.start()
        while end > 0 and text[end - 1] in WHITE:
            end -= 1
        yield end - len(second[1])


def _repeated_tokens(text: str) -> str:
    return _collapsed(text, _first_copies(text, _TOKEN_SIGN), _REPEATED_TOKEN)


def _repeated_words(text: str) -> str:
    """Of phrases that come three times in a row, all words but the first and the last are whole: with k words in a phrase, 2k - 2 in
    a row equal the one that comes k later."""
    text = _collapsed(text, _first_copies(text, _WORD_SIGN), _REPEATED_WORD)
    words = _words(text)
    if not any(b"\1" * (2 * k - 2) in bytes(map(eq, words, words[k:])) for k in (2, 3, 4)):
        return text
    return _collapsed(text, sorted({m.end() - len(m[2]) for sign in _PHRASE_SIGNS for m in sign.finditer(text)}), _REPEATED_PHRASE)


_ONLY_MARKS = _compiled(rf"[？！.،\-{WS[1:-1]}]{{5,}}\z")


@_by_line
def _garbage_symbols(line: str, t: str, *confidence: float | None) -> str:
    first = _REAL.search(t)
    some = first is not None and _REAL.search(t, first.end()) is not None
    if _ONLY_MARKS.match(t):
        return ""
    if some or len(t) < 2:
        return line
    n = _solid_length(t)
    odd = n - (first is not None)
    if confidence:
        noisy = confidence[0] is not None and odd > (0.6 + (1.0 - confidence[0]) * 0.2) * n
    else:
        noisy = 10 * odd > 7 * n
    return "" if n > 5 and noisy else line


def _after_arabic(text: str, mark: str, to: str) -> str:
    """``mark`` becomes ``to`` where an Arabic letter comes before it, or before the white space before it."""
    parts = text.split(mark)
    out = [parts[0]]
    for before, part in pairwise(parts):
        out += [to if _ARABIC.match(before.rstrip(WHITE)[-1:]) else mark, part]
    return "".join(out)


#: Of the patterns without a mark, the texts of which one is in all that they replace.
_SIGNS = {"[«»‹›〈〉]": "«»‹›〈〉", "[—ー‒]": "—ー‒", r"\.{3,}|[…⋯]+": ("...", "…", "⋯")}
_AFTER = f"({P.ARABIC}{WS}*)"
_PUNCTUATION = [
    ((mark,) if mark else tuple(_SIGNS[pattern]), None if pattern.startswith(_AFTER) else _compiled(pattern), to.removeprefix("$1") if pattern.startswith(_AFTER) else to.replace("$1", r"\1"))
    for mark, pattern, to in P.PUNCTUATION
]


def _punctuation(text: str) -> str:
    for signs, pattern, to in _PUNCTUATION:
        if any(sign in text for sign in signs):
            text = _after_arabic(text, signs[0], to) if pattern is None else pattern.sub(to, text)
    return text


@_by_line
def _isolated_fragments(line: str, t: str, *confidence: float | None) -> str:
    c = confidence[0] if confidence else None
    least = 2 if c is not None and not c <= 0.8 else 3
    return "" if t and len(t) <= least and not t.startswith(("#", "- ", "> ")) and not _REAL.search(t) else line


def _headings_of(major: re.Pattern, minor: re.Pattern):
    @_by_line
    def run(line: str, t: str) -> str:
        if not t or t.startswith(_HEADINGS):
            return line
        return "## " + t if major.match(t) else "### " + t if minor.match(t) else line

    return run


_headings = _headings_of(_one_of(P.HEADING_MAJOR, P.HEADING_NUMBERED_ANY, P.HEADING_PAREN, P.HEADING_EXAMPLE, P.HEADING_PARTICIPATION), _one_of(P.HEADING_SUB, P.HEADING_ORDINAL))
_late_headings = _headings_of(_one_of(P.HEADING_MAJOR, P.HEADING_PAREN, P.HEADING_NUMBERED, P.HEADING_EXAMPLE, P.HEADING_PARTICIPATION), _compiled(P.HEADING_SUB))
_PAGE_NOISE = _one_of(*P.PAGE_NUMBERS, r"^[•·\-–—*]+\z", rf"^[\d\-–—|/\\{WS[1:-1]}]+\z")
_CAPITALS = _compiled(rf"[A-Z{WS[1:-1]}]{{3,}}\z")


def _page_noise(text: str) -> str:
    trimmed = ((line, line.strip(WHITE)) for line in text.split("\n"))
    return "\n".join([line for line, t in trimmed if not t or not _PAGE_NOISE.match(t) and not (len(t) < 20 and _CAPITALS.match(t))])


_EXCLAIMED = _compiled(rf"({_LETTER})!+({_LETTER})")
_LEADING_JUNK, _JUNK, _BEFORE_JUNK, _DECOR = _compiled(r"[^\x{0600}-\x{06FF}A-Za-z0-9_]*"), _compiled(P.JUNK), _compiled(P.BEFORE_JUNK), _compiled(rf"[\-–—•·*{WS[1:-1]}]+\z")
_UNKNOWN = _compiled(f"[^{P.KNOWN}{WS[1:]}")


def _final_line(line: str) -> str | None:
    if "!" in line:
        line = _EXCLAIMED.sub(r"\1\2", line)
    if not (line.startswith((*_HEADINGS, "- ", "> ")) or _BULLET.match(line)):
        line = line[_LEADING_JUNK.match(line).end() :]
    if line and _JUNK.match(line[-1]):
        line = _BEFORE_JUNK.match(line)[1]
    t = line.strip(WHITE)
    if not t or _DECOR.match(t):
        return None
    if _UNKNOWN.search(t):
        n, unknown = _solid_length(t), len(_UNKNOWN.findall(t))
        if n >= 3 and 100 * (n - unknown) < round(100 * (1 - P.GARBAGE_THRESHOLD)) * n:
            return None
    return line


def _final_cleanup(text: str) -> str:
    return "\n".join([line for line in map(_final_line, text.split("\n")) if line is not None])


_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")

#: In their order: the option that turns a pass on, the pass, the name of its SQL form where it has one.
TEXT_PASSES = (
    ("normalize_unicode", compose, None),
    ("normalize_unicode", lambda t: t if t.isascii() else _CONTROLS.sub("", t), "strip_controls"),
    ("normalize_arabic", _letters, "normalize_letters"),
    ("remove_tashkeel", lambda t: _TASHKEEL.sub("", t), "remove_tashkeel"),
    ("remove_tatweel", lambda t: t.replace("ـ", ""), "remove_tatweel"),
    ("normalize_digits", lambda t: t.translate(_DIGITS), "normalize_digits"),
    ("normalize_whitespace", _whitespace, "normalize_whitespace"),
    ("remove_broken_html", _broken_html, "remove_broken_html"),
    ("remove_ascii_noise", _ascii_noise, "remove_ascii_noise"),
    ("remove_repeated_tokens", _repeated_tokens, "remove_repeated_tokens"),
    ("remove_garbage_symbols", _garbage_symbols, "remove_garbage_symbols"),
    ("normalize_punctuation", _punctuation, "normalize_punctuation"),
    ("remove_isolated_fragments", _isolated_fragments, "remove_isolated_fragments"),
    ("collapse_repeated_words", _repeated_words, "collapse_repeated_words"),
    ("detect_headings", _headings, "detect_headings"),
    ("reconstruct_lines", merge_lines, None),
    ("reconstruct_lines", _late_headings, "detect_late_headings"),
    ("remove_page_noise", _page_noise, "remove_page_noise"),
    ("collapse_repeated_paragraphs", drop_near_paragraphs, None),
    ("final_cleanup", _final_cleanup, "final_cleanup"),
)
#: The passes that a confidence changes.
CONFIDENT = ("remove_garbage_symbols", "remove_isolated_fragments")


# --- the composition ---


@dataclass(frozen=True)
class CleanOptions:
    """Which passes run; the defaults are those for general documents."""

    normalize_unicode: bool = True
    normalize_arabic: bool = True
    remove_tashkeel: bool = False
    remove_tatweel: bool = True
    normalize_digits: bool = False
    normalize_whitespace: bool = True
    remove_broken_html: bool = True
    remove_ascii_noise: bool = True
    remove_repeated_tokens: bool = True
    remove_garbage_symbols: bool = True
    normalize_punctuation: bool = True
    remove_isolated_fragments: bool = True
    collapse_repeated_words: bool = True
    detect_headings: bool = True
    reconstruct_lines: bool = True
    remove_page_noise: bool = True
    collapse_repeated_paragraphs: bool = True
    final_cleanup: bool = True


GENERAL = CleanOptions()
#: For exam papers: passes that mangle numbered questions and answer choices are off.
EXAM = CleanOptions(remove_ascii_noise=False, remove_garbage_symbols=False, remove_isolated_fragments=False, reconstruct_lines=False, detect_headings=False, final_cleanup=False)


def exam_score(d: Dialect, x: str) -> str:
    """How much a text looks like an exam, by its first 3000 characters; from 4 on it is one."""
    head = f"substring({x}, 1, 3000)" if not d.duck else f"{x}[1:3000]"
    tests = " + ".join(f"case when {d.matches('s', p)} then {n} else 0 end" for p, n in P.EXAM_SCORES)
    return d.let(head, "s", f"({tests} + case when {d.count('s', P.EXAM_QUESTION)} >= 3 then 3 else 0 end)")


def clean_text(text: str, options: CleanOptions, *confidence: float | None) -> str:
    """One text, cleaned. confidence: none, or one double that may be null."""
    for option, make, _ in TEXT_PASSES:
        if getattr(options, option):
            text = make(text, *confidence) if option in CONFIDENT else make(text)
    return text


def clean(df: DataFrame, column: str = "text", name: str = "cleaned", options: CleanOptions = GENERAL, mode: str = "general", confidence: str | None = None) -> DataFrame:
    """``df`` with the cleaned text of ``column``, in Arrow batches; what else ``df`` holds goes along, so ask for what is needed first.

    mode: "general" (``options``), "exam", or "auto" (each text by its exam score). confidence: a column of doubles, or None.
    A null text stays null. The passes run text by text, one after the other: as SQL, each would decode a text anew and keep its lines
    as arrays of rows.
    """
    by_row = {}
    if mode == "auto":
        by_row["__qs_exam"] = F.coalesce(F.expr(exam_score(SPARK, f"`{column}`")) >= P.EXAM_CUTOFF, F.lit(False))
    if confidence is not None:
        by_row["__qs_confidence"] = F.expr(confidence).cast("double")
    df = df.withColumns(by_row).withColumn(name, F.col(f"`{column}`"))
    schema, place = df.schema, df.columns.index(name)
    same = EXAM if mode == "exam" else options

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            exams = [EXAM if e else same for e in batch.column("__qs_exam").to_pylist()] if mode == "auto" else repeat(same)
            sure = ((c,) for c in batch.column("__qs_confidence").to_pylist()) if confidence is not None else repeat(())
            field = batch.schema.field(place)
            texts = [None if t is None else clean_text(t, o, *c) for t, o, c in zip(batch.column(place).to_pylist(), exams, sure)]
            yield batch.set_column(place, field, pa.array(texts, type=field.type))

    return df.mapInArrow(run, schema).drop(*by_row)


def pass_names() -> list[str]:
    return [f.name for f in fields(CleanOptions)]

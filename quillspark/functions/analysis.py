"""Measures and labels of texts: quality, structure, script, type, OCR."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import patterns as P
from quillspark.functions.dialect import NOT_WS, SPARK, WS, Dialect

WORDS_PER_PAGE = 250
RETRY_CONFIDENCE = 0.65


def word_count(d: Dialect, x: str) -> str:
    return d.word_count(x)


def headings(d: Dialect, x: str, level: int) -> str:
    return d.size(d.filter(d.split(x, "\n"), "l", d.starts("l", "#" * level + " ")))


def script_ratio(d: Dialect, x: str, script: str = P.ARABIC) -> str:
    """Characters of a script among those that aren't white space; 0 for none."""
    return d.let(d.solid(x), "c", d.ratio(d.count_class("c", script), "length(c)"))


def garbage_ratio(d: Dialect, x: str, script: str = P.ARABIC) -> str:
    """Lines with little of the script, among lines of over five characters."""
    long = d.filter(d.split(x, "\n"), "l", f"length({d.trim('l')}) > 5")
    bad = d.filter("ls", "m", d.let(d.solid("m"), "c", f"length(c) >= 5 and {d.count_class('c', script)} < 0.3 * length(c)"))
    return d.let(long, "ls", d.ratio(d.size(bad), d.size("ls")))


def html_fragments(d: Dialect, x: str) -> str:
    return d.count(x, P.HTML_FRAGMENT)


def paragraphs(d: Dialect, x: str) -> str:
    """Blocks between blank lines with more than ten characters."""
    parts = f"regexp_split_to_array({x}, {d.lit(chr(10) + chr(10) + '+')})" if d.duck else f"split({x}, {d.lit(chr(10) + chr(10) + '+')}, -1)"
    return d.size(d.filter(parts, "p", f"length({d.trim('p')}) > 10"))


def page_estimate(d: Dialect, words: str) -> str:
    return f"greatest(cast(1 as bigint), cast(ceil({words} / {float(WORDS_PER_PAGE)}) as bigint))"


def quality_score(d: Dialect, script: str, heads: str, words: str, blocks: str, garbage: str) -> str:
    """0..100 from the shares of script and garbage and the counts of headings, words and paragraphs."""
    per_size = f"greatest(1.0, ceil({words} / 500.0))"
    score = (
        f"least(1.0, {script} / 0.9) * 30 + least(1.0, {heads} / {per_size}) * 20 + case when {blocks} > 1 then 15 when {blocks} = 1 then 5 else 0 end"
        f" + case when {words} > 100 then 15.0 else cast({words} as double) / 100 * 15 end - {garbage} * 20"
    )
    return d.round_half_up(f"greatest(cast(0 as double), least(cast(100 as double), cast({score} as double)))")


METRICS = ("heading_count", "level1_heading_count", "level2_heading_count", "level3_heading_count", "word_count", "char_count", "arabic_ratio", "garbage_ratio", "html_fragment_count", "paragraph_count", "page_count", "quality_score")


def measures(d: Dialect, x: str, script: str = P.ARABIC) -> dict[str, str]:
    """SQL of the measures that need the text, by name."""
    return {
        "level1_heading_count": headings(d, x, 1),
        "level2_heading_count": headings(d, x, 2),
        "level3_heading_count": headings(d, x, 3),
        "word_count": word_count(d, x),
        "char_count": f"length({x})",
        "arabic_ratio": script_ratio(d, x, script),
        "garbage_ratio": garbage_ratio(d, x, script),
        "html_fragment_count": html_fragments(d, x),
        "paragraph_count": paragraphs(d, x),
    }


def derived(d: Dialect) -> dict[str, str]:
    """SQL of the measures that follow from others."""
    heads = "level1_heading_count + level2_heading_count + level3_heading_count"
    return {
        "heading_count": heads,
        "page_count": page_estimate(d, "word_count"),
        "quality_score": quality_score(d, "arabic_ratio", f"({heads})", "word_count", "paragraph_count", "garbage_ratio"),
    }


def analyze(df: DataFrame, column: str = "text", script: str = P.ARABIC) -> DataFrame:
    """``df`` with the twelve metrics of each text; a null text is read as an empty one."""
    text = f"coalesce(`{column}`, '')"
    df = df.withColumns({n: F.expr(e).cast("double" if n.endswith("ratio") else "long") for n, e in measures(SPARK, text, script).items()})
    return df.withColumns({n: F.expr(e).cast("long") for n, e in derived(SPARK).items()})


def export_metrics(d: Dialect, x: str) -> dict[str, str]:
    """Counts and quality as exports state them."""
    blocks = f"regexp_split_to_array({x}, {d.lit(f'{chr(10)}{WS}*{chr(10)}')})" if d.duck else f"split({x}, {d.lit(f'{chr(10)}{WS}*{chr(10)}')}, -1)"
    garbage = d.list_sum(d.map(d.extract_all(x, "[□■◆◇○●△▲▽▼]{3,}"), "g", "cast(length(g) as bigint)"))
    return {
        "word_count": word_count(d, x),
        "paragraph_count": d.size(d.filter(blocks, "p", "p <> ''")),
        "heading_count": d.count(x, f"(?m)^#{{1,6}}{WS}+"),
        "quality": f"case when length({x}) > 0 then greatest(cast(0 as double), 1 - cast({garbage} as double) / length({x})) else cast(0 as double) end",
    }


def ocr_metrics(d: Dialect, x: str) -> dict[str, str]:
    squeezed = f"length({d.replace(x, WS + '+', ' ')})"
    return {
        "arabic_ratio": d.ratio(d.count(x, r"[\x{0600}-\x{06FF}]"), squeezed),
        "diacritics_ratio": d.ratio(d.count(x, r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}]"), f"length({x})"),
        "table_hints": d.count(x, r"\|"),
    }


def estimated_confidence(d: Dialect, x: str) -> str:
    """A confidence guessed from the share of Arabic among what isn't white space; 0 for nothing."""
    ratio = d.ratio(d.count_class("c", P.ARABIC), "length(c)")
    return d.let(d.solid(x), "c", f"case when c = '' then cast(0 as double) when {ratio} > 0.7 then cast(0.9 as double) when {ratio} > 0.4 then cast(0.7 as double) else cast(0.5 as double) end")


def page_label(d: Dialect, text: str, confidence: str) -> str:
    """Why a page needs another look, or null."""
    shown = f"printf('%.2f', {confidence})" if d.duck else f"format_string('%.2f', cast({confidence} as double))"
    return f"case when coalesce({text}, '') = '' then 'NO_TEXT' when {confidence} < {RETRY_CONFIDENCE} then concat('LOW_CONFIDENCE:', {shown}) end"


def alignment(d: Dialect, x: str) -> str:
    """right where Arabic letters prevail or are as many, left where Latin ones do, null without either."""
    arabic, latin = d.count(x, r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"), d.count(x, "[A-Za-z]")
    return f"case when {arabic} > 0 and {arabic} >= {latin} then 'right' when {latin} > {arabic} then 'left' end"


def is_quranic(d: Dialect, x: str) -> str:
    """Quran brackets, or over 0.3 marks a letter."""
    marks = d.ratio(d.count(x, P.TASHKEEL), d.count(x, r"[\x{0600}-\x{06FF}]"))
    return f"({d.matches(x, '[﴿﴾]')} or {marks} > 0.3)"


def heading_level_of_size(size: str, mean: str) -> str:
    """1..6 by how much larger than the mean a font is."""
    ratio = f"({size} / greatest({mean}, 1.0))"
    return f"case when {ratio} >= 2.0 then 1 when {ratio} >= 1.6 then 2 when {ratio} >= 1.3 then 3 when {ratio} >= 1.2 then 4 when {ratio} >= 1.1 then 5 else 6 end"


def indentation(d: Dialect, x: str) -> str:
    """Levels of four columns, a tab being four."""
    lead = f"regexp_extract({x}, {d.lit('^' + WS + '+')}, 0)"
    return f"cast(floor(length({d.replace(lead, chr(92) + 't', '    ')}) / 4) as bigint)"


def squeeze(d: Dialect, x: str) -> str:
    return d.trim(d.single_spaced(x))


def character_error_rate(truth: str, prediction: str) -> str:
    """Edit distance by the length of the truth, on texts with white space squeezed; an empty prediction is all wrong."""
    return f"case when {prediction} = '' then cast(1 as double) when {truth} = '' then cast(length({prediction}) as double) else cast(levenshtein({truth}, {prediction}) as double) / length({truth}) end"


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and substitutions between two sequences, a row of the table at a time."""
    numbers: dict = {}
    x, y = (np.array([numbers.setdefault(w, len(numbers)) for w in s], dtype=np.int64) for s in (a, b))
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, one in enumerate(x, 1):
        made = np.minimum(row[1:] + 1, row[:-1] + (y != one))
        row = np.minimum.accumulate(np.concatenate([[i], made]) - place) + place  # insertions run along the row
    return int(row[-1])


@F.pandas_udf(T.DoubleType())
def word_error_rate(truth: pd.Series, prediction: pd.Series) -> pd.Series:
    def one(t, p):
        if t is None or p is None:
            return None
        a, b = t.split(), p.split()
        return 1.0 if not b else edit_distance(a, b) / max(1, len(a))

    return pd.Series([one(t, p) for t, p in zip(truth, prediction)], dtype="float64")

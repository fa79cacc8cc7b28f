"""Markdown as typed blocks and back.

The grammar is sequential (a line's meaning depends on the block it continues),
so texts are parsed in Arrow functions, one text at a time; what follows on
blocks (outlines, counts, exports) is built-in functions again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import patterns as P

RUN = T.StructType([T.StructField("content", T.StringType()), *[T.StructField(n, T.BooleanType()) for n in ("bold", "italic", "strikethrough")]])
BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("ordered", T.BooleanType()),
    T.StructField("start_number", T.IntegerType()),
    T.StructField("alignment", T.StringType()),
    T.StructField("content", T.ArrayType(RUN)),
    T.StructField("items", T.ArrayType(T.ArrayType(RUN))),
    T.StructField("code", T.StringType()),
])
BLOCKS = T.ArrayType(BLOCK)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")
_RULE = re.compile(r"^(?:-{3,}|\*{3,}|_{3,})$")
_BULLET = re.compile(r"^[•·\-–—*○▪]\s+")
_NUMBER = re.compile(r"^([0-9]+)[.)]\s+")
_LETTER = re.compile(r"^[أ-ي][.)]\s+")
_SEPARATOR = re.compile(r"^\s*\|?[\s:|-]+\|?\s*$")
_EMPHASIS = re.compile(r"\*\*([^*]+)\*\*|\*([^*]+)\*|~~([^~]+)~~")
_ARABIC = re.compile("[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]")
_LATIN = re.compile("[A-Za-z]")


def _run(content: str, style: int = 0) -> dict:
    return {"content": content, "bold": style == 1, "italic": style == 2, "strikethrough": style == 3}


def inline(text: str) -> list[dict]:
    """Runs of a text by emphasis."""
    out, at = [], 0
    for m in _EMPHASIS.finditer(text):
        if m.start() > at:
            out.append(_run(text[at : m.start()]))
        out.append(_run(m[m.lastindex], m.lastindex))
        at = m.end()
    if at < len(text):
        out.append(_run(text[at:]))
    return out or [_run("")]


def merge_runs(runs: list[dict]) -> list[dict]:
    """Neighbours of equal emphasis become one."""
    out: list[dict] = []
    for run in runs:
        if out and all(out[-1][k] == run[k] for k in ("bold", "italic", "strikethrough")):
            out[-1] = {**out[-1], "content": out[-1]["content"] + run["content"]}
        else:
            out.append(dict(run))
    return out


def _depth(line: str) -> int:
    return len(line[: len(line) - len(line.lstrip())].replace("\t", "    ")) // 4


def _ordered(line: str) -> bool | None:
    """Whether a trimmed line opens an ordered item, an unordered one, or (None) no item."""
    if _NUMBER.match(line) or _LETTER.match(line):
        return True
    return False if _BULLET.match(line) else None


def _bare(line: str) -> str:
    for marker in (_BULLET, _NUMBER, _LETTER):
        line = marker.sub("", line)
    return line.strip()


def _block(kind: str, **values) -> dict:
    return {"type": kind, "level": None, "ordered": None, "start_number": None, "alignment": None, "content": None, "items": None, "code": None, **values}


class _Parser:
    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.at = 0
        self.blocks: list[dict] = []

    def table_at(self, i: int) -> bool:
        line = self.lines[i].strip()
        if sum(bool(c.strip()) for c in line.split("|")) < 2 or "|" not in line:
            return False
        below = self.lines[i + 1].strip() if i + 1 < len(self.lines) else ""
        return bool(_SEPARATOR.match(below)) if below else True

    def parse(self) -> list[dict]:
        while self.at < len(self.lines):
            line = self.lines[self.at].strip()
            if not line or _RULE.match(line) and not line.startswith("```"):
                self.at += 1
            elif line.startswith("```"):
                self.fence()
            elif m := _HEADING.match(line):
                self.blocks.append(_block("heading", level=len(m[1]), content=[_run(m[2].strip())]))
                self.at += 1
            elif _ordered(line) is not None:
                self.list()
            elif self.table_at(self.at):
                self.table()
            else:
                self.paragraph()
        return self.blocks

    def fence(self) -> None:
        start = self.at + 1
        end = next((i for i in range(start, len(self.lines)) if self.lines[i].strip().startswith("```")), len(self.lines))
        self.blocks.append(_block("code-block", code="\n".join(self.lines[start:end])))
        self.at = end + 1

    def list(self) -> None:
        first = self.lines[self.at]
        kind, depth = _ordered(first.strip()), _depth(first)
        number = _NUMBER.match(first.strip())
        items: list[list[dict]] = []
        while self.at < len(self.lines):
            raw = self.lines[self.at]
            line = raw.strip()
            if not line or re.match(r"^#{1,6}\s", line) or _RULE.match(line):
                break
            opens = _ordered(line)
            if opens is not None:
                if opens != kind:
                    break
                items.append(inline(_bare(line)))
            elif _depth(raw) > depth:
                items[-1].append(_run(" " + line))
            else:
                break
            self.at += 1
        start = int(number[1]) or None if number else None
        self.blocks.append(_block("list", ordered=kind, start_number=start, items=items))

    def table(self) -> None:
        rows = []
        while self.at < len(self.lines) and "|" in self.lines[self.at]:
            line = self.lines[self.at].strip()
            if not _SEPARATOR.match(line):
                rows.append(" | ".join(c.strip() for c in re.sub(r"^\||\|$", "", line).split("|")))
            self.at += 1
        self.blocks.append(_block("paragraph", content=[_run("\n".join(rows))]))

    def paragraph(self) -> None:
        parts = []
        while self.at < len(self.lines):
            line = self.lines[self.at].strip()
            if not line or parts and (line.startswith("#") or _ordered(line) is not None or _RULE.match(line) or self.table_at(self.at)):
                break
            parts.append(line)
            self.at += 1
        text = "\n".join(parts)
        arabic, latin = len(_ARABIC.findall(text)), len(_LATIN.findall(text))
        side = "right" if arabic and arabic >= latin else "left" if latin > arabic else None
        self.blocks.append(_block("paragraph", alignment=side, content=merge_runs(inline(text))))


def parse(text: str) -> list[dict]:
    return _Parser(text).parse()


def _marked(runs: list[dict]) -> str:
    out = []
    for r in runs:
        mark = "**" if r["bold"] else "*" if r["italic"] else "~~" if r["strikethrough"] else ""
        out.append(f"{mark}{r['content']}{mark}")
    return "".join(out)


def render(blocks: list[dict]) -> str:
    """Blocks as markdown."""
    out = []
    for b in blocks:
        if b["type"] == "heading":
            out.append("#" * b["level"] + " " + _marked(b["content"]))
        elif b["type"] == "list":
            first = b["start_number"] or 1
            out.append("\n".join((f"{first + i}. " if b["ordered"] else "- ") + _marked(item) for i, item in enumerate(b["items"])))
        elif b["type"] == "code-block":
            out.append(f"```\n{b['code']}\n```")
        else:
            out.append(_marked(b["content"]))
    return "\n\n".join(out)


@F.pandas_udf(BLOCKS)
def blocks_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else parse(t))


def with_blocks(df: DataFrame, column: str = "text", name: str = "blocks") -> DataFrame:
    """``df`` with the blocks of a markdown text; null stays null, an empty text has none."""
    return df.withColumn(name, blocks_of(F.col(f"`{column}`").cast("string")))


def block_text(block: str = "b") -> Column:
    """The plain text of a block: items joined by slashes, code as it is."""
    runs = lambda x: f"trim(array_join(transform({x}, r -> r.content), ''))"
    return F.expr(f"case {block}.type when 'list' then array_join(transform({block}.items, i -> {runs('i')}), ' / ') when 'code-block' then {block}.code else {runs(f'{block}.content')} end")


def explode_blocks(df: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """A row for each block: keys, place, type, level, plain text."""
    each = df.select(*keys, F.posexplode(blocks).alias("place", "b"))
    return each.select(*keys, "place", F.col("b.type").alias("type"), F.col("b.level").alias("level"), block_text().alias("plain"))


def outline(df: DataFrame, keys: list[str], blocks: str = "blocks") -> DataFrame:
    """The headings of each text, in order."""
    return explode_blocks(df, keys, blocks).where("type = 'heading'").select(*keys, "place", "level", F.col("plain").alias("title"))


def _markdown(blocks: str) -> Column:
    """Blocks as markdown, with built-in functions."""
    run = "concat(if(r.bold, '**', if(r.italic, '*', if(r.strikethrough, '~~', ''))), r.content, if(r.bold, '**', if(r.italic, '*', if(r.strikethrough, '~~', ''))))"
    runs = lambda x: f"array_join(transform({x}, r -> {run}), '')"
    item = f"concat(if(b.ordered, concat(cast(coalesce(b.start_number, 1) + n as string), '. '), '- '), {runs('i')})"
    body = f"case b.type when 'heading' then concat(repeat('#', b.level), ' ', {runs('b.content')}) when 'list' then array_join(transform(b.items, (i, n) -> {item}), '\\n') when 'code-block' then concat('```\\n', b.code, '\\n```') else {runs('b.content')} end"
    return F.expr(f"array_join(transform({blocks}, b -> {body}), '\\n\\n')")


def render_markdown(df: DataFrame, blocks: str = "blocks", name: str = "markdown") -> DataFrame:
    return df.withColumn(name, _markdown(f"`{blocks}`"))


def protected_spans(text: str) -> list[dict]:
    """Spans that restoration must not touch: quoted verses, references to laws; overlapping ones merged."""
    found = []
    for m in re.finditer(P.QUOTED, text):
        quote = m.group()
        letters = len(re.findall(P.QUOTED_LETTERS, quote))
        if any(b in quote for b in P.VERSE_BRACKETS) or letters and len(re.findall(P.QUOTED_MARKS, quote)) / letters > P.MARKS_A_LETTER:
            found.append(m.span())
    found += [m.span() for m in re.finditer(P.LAW, text)]
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


@F.pandas_udf(SPANS)
def protected_spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else protected_spans(t))


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("plain", T.StringType())]))
class ExplodeBlocks:
    """Table function: the blocks of one markdown text as rows."""

    def eval(self, text: str):
        for place, b in enumerate(parse(text or "")):
            if b["type"] == "list":
                plain = " / ".join("".join(r["content"] for r in i).strip() for i in b["items"])
            elif b["type"] == "code-block":
                plain = b["code"]
            else:
                plain = "".join(r["content"] for r in b["content"]).strip()
            yield place, b["type"], b["level"], plain

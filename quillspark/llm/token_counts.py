"""Operator 10, token counts: encode whole documents once and attribute tokens to the sections whose characters they span.

The tokenizer is byte-level: its tokens tile the bytes of a text, so running
sums of token lengths give every token's span. Sections tile the text too, so
the interval join of the two is a merge of sorted bounds. A token that crosses
a boundary is allocated by rule: "start" (to the section of its first
character), "largest" (to the one that holds most of its bytes, the earliest
of equals) or "split" (to each by its share of bytes).
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import add_columns, field, table

RULES = ("start", "largest", "split")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer, and the bytes that each id stands for, counted."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


#: White space as the tokenizer's splitter knows it, and runs of it that the splitter's stack may not survive.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = 100_000


def encode_whole(tokenizer, text: str) -> list[int]:
    """The ids of a text. The splitter takes a run of white space up to the one before the last, if something follows, as one
    piece, and backtracks over it; a very long run is cut there beforehand and merged as the piece that it is, which gives the same."""
    if len(text) < LONG_RUN:
        return tokenizer.encode_ordinary(text)
    ids, at = [], 0
    for run in re.finditer(f"{_SPACE}{{{LONG_RUN},}}", text):
        end = run.end() - (run.end() < len(text))
        ids += tokenizer.encode_ordinary(text[at : run.start()])
        ids += tokenizer._encode_single_piece(text[run.start() : end].encode("utf-8"))
        at = end
    return ids + tokenizer.encode_ordinary(text[at:])


def token_ends(text: str, path: str) -> tuple[list[int], np.ndarray]:
    """The ids of a text and the byte at which each token ends."""
    tokenizer, lengths = encoding(path)
    ids = encode_whole(tokenizer, text)
    return ids, np.cumsum(lengths[np.asarray(ids, dtype=np.int64)]) if ids else np.zeros(0, dtype=np.int64)


def line_sections(raw: bytes) -> np.ndarray:
    """The bytes at which the sections of a text end: its lines, each with the newline that closes it. An empty text has no section."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) or not raw else np.append(ends, len(raw))


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, as doubles; both tile the same bytes, sections are not empty. The sum is the number of tokens."""
    sections, tokens = len(section_ends), len(token_ends)
    if not sections or not tokens:
        return np.zeros(sections)
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    if rule == "start":
        return np.bincount(first, minlength=sections).astype(float)
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    out = np.bincount(first[first == last], minlength=sections).astype(float)
    section_starts = np.concatenate([[0], section_ends[:-1]])
    for t in np.flatnonzero(first != last):
        held = np.arange(first[t], last[t] + 1)
        shares = np.minimum(section_ends[held], token_ends[t]) - np.maximum(section_starts[held], starts[t])
        if rule == "largest":
            out[held[np.argmax(shares)]] += 1
        else:
            out[held] += shares / (token_ends[t] - starts[t])
    return out


def paragraph_sections(raw: bytes) -> np.ndarray:
    """As :func:`line_sections`, where a section is a paragraph with the empty lines that close it."""
    ends = np.array([m.end() for m in re.finditer(rb"\n\n+", raw)], dtype=np.int64)
    return ends if len(ends) and ends[-1] == len(raw) or not raw else np.append(ends, len(raw))


SECTIONS = {"lines": line_sections, "paragraphs": paragraph_sections}


def section_counts(docs: DataFrame, rule: str = "largest", path: str | None = None, text_column: str = "text", keep: list[str] | None = None, sections: str = "lines") -> DataFrame:
    """A row for each section (line or paragraph) of each document: the columns of ``docs`` (or those in ``keep``), n_tokens (of the document), section
    (from 0), char_start, char_end, section_tokens (double, by ``rule``) and n_crossing (tokens of the document that cross sections).

    Texts of any length are encoded whole, long runs of white space among them. A null or empty text gives one row with section null and no tokens, so that every row of ``docs`` is in the result. Each row by
    itself: repeated rows, ids and null ids need no care. Columns of ``docs`` with the name of a result column are replaced.
    """
    if sections not in SECTIONS:
        raise ValueError(f"sections must be one of {sorted(SECTIONS)}")
    cut = SECTIONS[sections]

    def parts(text):
        raw = text.encode("utf-8")
        return text, raw, cut(raw)

    return _counts(docs, rule, path, text_column, keep, parts)


def field_counts(docs: DataFrame, fields: list[str], rule: str = "largest", path: str | None = None, keep: list[str] | None = None, separator: str = "\n") -> DataFrame:
    """As :func:`section_counts` for documents that consist of several columns: their texts, each but the last followed by
    ``separator``, which counts with the text before it, are encoded as one; ``section`` is the number of a field in ``fields``.

    A null field is an empty one, and has its row, with no tokens but those of its separator.
    """
    texts = [F.concat(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")), F.lit(separator if i + 1 < len(fields) else "")) for i, f in enumerate(fields)]
    sizes = F.concat_ws(",", *[F.octet_length(t).cast("string") for t in texts])
    joined = docs.withColumn("__qs_fields", F.concat(sizes, F.lit(";"), *texts))  # sizes first, so that any text can follow

    def parts(text):
        head, _, text = text.partition(";")
        return text, text.encode("utf-8"), np.cumsum(np.array(head.split(","), dtype=np.int64))

    carried = docs.columns if keep is None else keep
    return _counts(joined, rule, path, "__qs_fields", carried, parts)


def _counts(docs: DataFrame, rule: str, path: str | None, text_column: str, keep: list[str] | None, parts_of) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path()
    section = T.StructType([field("section", T.IntegerType()), field("char_start", T.LongType()), field("char_end", T.LongType()), field("section_tokens", T.DoubleType())])
    fields = [field("n_tokens", T.LongType()), field("n_crossing", T.LongType()), field("__qs_sections", T.ArrayType(section))]

    def run(texts):
        totals, crossing, sections = [], [], []
        for text in texts:
            text, raw, parts = parts_of(text.as_py())
            ids, ends = token_ends(text, path)
            counts = allocate(ends, parts, rule)
            byte = np.frombuffer(raw, dtype=np.uint8)
            chars = parts if len(text) == len(raw) else np.concatenate([[0], np.cumsum((byte & 0xC0) != 0x80)])[parts]
            totals.append(len(ids))
            crossing.append(len(np.setdiff1d(parts[:-1], [0, *ends])) if len(parts) else 0)
            begin = [0, *chars[:-1].tolist()] if len(parts) else []
            sections.append([{"section": i, "char_start": a, "char_end": b, "section_tokens": c} for i, (a, b, c) in enumerate(zip(begin, chars.tolist(), counts.tolist()))])
        return totals, crossing, sections

    names = ("section", "char_start", "char_end", "section_tokens", "n_tokens", "n_crossing")
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    made = add_columns(docs, text_column, fields, run, carried)
    return made.select(*[F.col(f"`{c}`") for c in carried], "n_tokens", "n_crossing", F.explode_outer("__qs_sections").alias("__qs_s")).select(
        *[F.col(f"`{c}`") for c in carried], "n_tokens", "n_crossing", "__qs_s.section", "__qs_s.char_start", "__qs_s.char_end", "__qs_s.section_tokens"
    )


def document_counts(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Sections rolled up by ``keys``: documents, sections and tokens."""
    return sections.groupBy(*keys).agg(
        F.sum(F.when(F.coalesce(F.col("section"), F.lit(0)) == 0, 1).otherwise(0)).alias("n_docs"),
        F.count("section").alias("n_sections"),
        F.coalesce(F.sum("section_tokens"), F.lit(0.0)).alias("n_tokens"),
    )


def op10_token_counts(spark, sf_dir):
    return section_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])

"""Operator 4, quality rules: a ledger of failure bits and measurements, judged by versioned policies.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one bit for each failed rule; a policy is a mask of the rules
it enforces, so trying another policy, or leaving a rule out, is bit arithmetic
on the ledger and never reads the texts again.
"""

from __future__ import annotations

from collections import Counter
from unicodedata import category

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import add_columns, field, materialize, table, without

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: What a document is measured by; all are counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")

#: Rule number (its bit), name, and the condition, in SQL, under which a document fails it. All arithmetic is on whole numbers.
RULES = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbol_density", "4 * n_symbols > n_words"),
    (3, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 40 * n_words"),
    (6, "shouting", "n_upper > 2 * n_lower and n_upper > 20"),
)
BITS = {name: 1 << bit for bit, name, _ in RULES}

#: Versions of the policy: the rules that each enforces.
POLICIES = {
    "base": BITS["few_words"] | BITS["repeated_words"],
    "v1": BITS["few_words"] | BITS["repeated_words"] | BITS["symbol_density"] | BITS["repeated_lines"],
    "v2": sum(BITS.values()),
}
CURRENT = "v2"


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes.split() parts at \\x20 and \\x09-\\x0D, no more
    n = len(words)
    spaces = raw.count(b" ") + raw.count(b"\n") + raw.count(b"\t") + raw.count(b"\r") + raw.count(b"\x0b") + raw.count(b"\x0c")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            reach = 0
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += i + 3 - max(i, reach)
                    reach = i + 3
    upper = lower = 0
    if not text.isascii() or text.lower() != text:
        counts = Counter(text)
        upper = sum(k for c, k in counts.items() if category(c) == "Lu")
        lower = sum(k for c, k in counts.items() if category(c) == "Ll") if upper else 0
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, lower


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for bit, _, condition in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with all measurements and ``failed``, the bits of failed rules.

    One row for each row: nothing is joined or shuffled, so repeated rows and
    ids, null ids and ties need no care. A null or empty text has no words and
    fails "few_words". n_dup_lines counts lines (split at \\n, holding a word)
    that equal an earlier line; n_lines the lines that hold a word; n_upper and
    n_lower the letters of Unicode's categories Lu and Ll, where there are any of upper case. Columns
    of ``docs`` with the name of a result column are replaced. An empty table
    gives an empty ledger.
    """
    fields = [field(m, T.LongType()) for m in MEASURES]

    def run(texts):
        rows = [measure(t) for t in texts.to_pylist()]
        return [list(c) for c in zip(*rows)] if rows else [[] for _ in fields]

    names = [*MEASURES, "failed"]
    carried = without(docs, names) if keep is None else keep
    return add_columns(docs, text_column, fields, run, carried).withColumn("failed", failure_bits())


def apply_policy(rows: DataFrame, version: str = CURRENT, name: str = "kept") -> DataFrame:
    """A ledger with the verdict of a policy: true if no rule that it enforces has failed."""
    return rows.withColumn(name, F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (and return if it is left out), and all that are dropped.

    The ledger shrinks to one row for each pattern of bits, at most 2 ** rules, before rules are told apart.
    """
    mask = POLICIES[version]
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("pattern")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if mask >> bit & 1]))
    each = patterns.select("pattern", "n", rules.alias("r"))
    hit = F.col("pattern").bitwiseAND(F.col("r.bit")) != 0
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("pattern") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(F.col("pattern") != 0, F.col("n"))), F.lit(0)).alias("n_dropped"),
    )


def op4_quality_rules(spark, sf_dir):
    judged = apply_policy(ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0).alias("base_failed"),
        "kept",
        "failed",
    )


def quality_ablations(spark, sf_dir):
    """Ablations of every policy from one stored ledger: the texts are measured once."""
    rows = materialize(ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("failed"), "ledger")
    made = [ablations(rows, version).withColumn("policy", F.lit(version)) for version in POLICIES]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


_WORD = r"[^\x20\x09-\x0D]+"
_FAILED = " + ".join(f"case when {c} then {1 << b} else 0 end" for b, _, c in RULES)
OP4_SQL = f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '{_WORD}') as words,
      list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{_WORD}')) as lines from t),
g as (select r, case when len(words) >= 3 then list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) else [] end as wins from w),
e as (select r, unnest(wins) as win, unnest(range(1, len(wins) + 1)) as i from g),
d as (select r, i from (select r, i, count(*) over (partition by r, win) as n from e) where n > 1),
p as (select r, count(distinct i + k) as n_repeat_words from d, (values (0), (1), (2)) as v(k) group by r),
m as (select w.r, doc_id, text, len(words)::bigint as n_words,
      coalesce(list_sum(list_transform(words, lambda s: length(s))), 0)::bigint as word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
      (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines)::bigint as n_lines,
      coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
      (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')))::bigint as n_upper,
      (length(text) - length(regexp_replace(text, '\\p{{Ll}}', '', 'g')))::bigint as n_lower
      from w left join p on w.r = p.r),
f as (select *, ({_FAILED})::bigint as failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {POLICIES["base"]}) <> 0 as base_failed, (failed & {POLICIES[CURRENT]}) = 0 as kept, failed from f
"""

_LEDGER_SQL = OP4_SQL.rsplit("select doc_id, n_words", 1)[0]
ABLATIONS_SQL = _LEDGER_SQL + " union all ".join(
    f"select '{version}' as policy, '{name}' as rule, count(*) filter (where failed & {1 << bit} <> 0) as n_failed, count(*) filter (where failed & {mask} = {1 << bit}) as n_failed_alone,"
    f" count(*) filter (where failed & {mask} <> 0) as n_dropped from f"
    for version, mask in POLICIES.items()
    for bit, name, _ in RULES
    if mask >> bit & 1
)

"""SQL expressions written once and rendered for Spark or for the DuckDB oracle.

Scalar functions of this library are compositions of built-in functions, so
each is a short piece of SQL. Rendering it for a second engine with regular
expressions, arrays and arithmetic of its own is what the oracles compare with.
"""

from __future__ import annotations

import re


class Dialect:
    def __init__(self, duck: bool = False):
        self.duck = duck

    def lit(self, text: str) -> str:
        if self.duck:
            return "'" + text.replace("'", "''") + "'"
        text = text.replace(NOT_WS, _INK).replace(WS, f"[^{_INK[1:]}")
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def replace(self, x: str, pattern: str, to: str) -> str:
        """All matches of a regular expression; groups in ``to`` are $1, $2."""
        if self.duck:
            return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(re.sub(r'[$](\d)', r'\\\1', to))}, 'g')"
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def chain(self, x: str, steps) -> str:
        for pattern, to in steps:
            x = self.replace(x, pattern, to)
        return x

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})" if self.duck else f"({x} rlike {self.lit(pattern)})"

    def count(self, x: str, pattern: str) -> str:
        return f"len(regexp_extract_all({x}, {self.lit(pattern)}))" if self.duck else f"regexp_count({x}, {self.lit(pattern)})"

    def count_class(self, x: str, one: str) -> str:
        """How many characters are of a class. ``x`` is named twice, so it should be a name. Spark takes whole runs away and compares
        lengths: an object for each run and not for each character."""
        return self.count(x, one) if self.duck else f"(length({x}) - length(regexp_replace({x}, {self.lit(one + '++')}, '')))"

    def either(self, pattern: str, guarded: str) -> str:
        """``pattern`` for DuckDB, which knows neither look-arounds nor possessive runs; for Spark one that finds the same in linear time."""
        return pattern if self.duck else guarded

    def when_it_has(self, x: str, part: str, body) -> str:
        """``body(x)`` where ``x`` contains ``part``, which all that ``body`` replaces does; else ``x``: a plain search is far cheaper than patterns."""
        return body(x) if self.duck else self.let(x, "g", f"if(contains(g, {self.lit(part)}), {body('g')}, g)")

    def extract_all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)})" if self.duck else f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def split(self, x: str, separator: str) -> str:
        """By a separator that is plain text."""
        return f"string_split({x}, {self.lit(separator)})" if self.duck else f"split({x}, {self.lit(re.escape(separator))}, -1)"

    def map(self, xs: str, v: str, body: str) -> str:
        return f"list_transform({xs}, lambda {v}: {body})" if self.duck else f"transform({xs}, {v} -> {body})"

    def filter(self, xs: str, v: str, body: str) -> str:
        return f"list_filter({xs}, lambda {v}: {body})" if self.duck else f"filter({xs}, {v} -> {body})"

    def join(self, xs: str, separator: str) -> str:
        return f"array_to_string({xs}, {self.lit(separator)})" if self.duck else f"array_join({xs}, {self.lit(separator)})"

    def size(self, xs: str) -> str:
        return f"len({xs})" if self.duck else f"size({xs})"

    def let(self, value: str, v: str, body: str) -> str:
        """``body`` with ``value`` computed once and called ``v``."""
        return f"list_transform([{value}], lambda {v}: {body})[1]" if self.duck else f"transform(array({value}), {v} -> {body})[0]"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def lines(self, x: str, v: str, body: str) -> str:
        """``x`` with each of its lines replaced by ``body``."""
        return self.join(self.map(self.split(x, "\n"), v, body), "\n")

    def keep_lines(self, x: str, v: str, condition: str) -> str:
        return self.join(self.filter(self.split(x, "\n"), v, condition), "\n")

    def starts(self, x: str, prefix: str) -> str:
        return f"starts_with({x}, {self.lit(prefix)})" if self.duck else f"startswith({x}, {self.lit(prefix)})"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {self.lit(part)})"

    def translate(self, x: str, source: str, target: str) -> str:
        return f"translate({x}, {self.lit(source)}, {self.lit(target)})"

    def trim(self, x: str) -> str:
        """Both ends, of all white space. A pattern would look at every run of it inside, from each of its characters."""
        return self.replace(x, f"^{WS}+|{WS}+\\z", "") if self.duck else f"trim(both {self.lit(WHITE)} from {x})"

    def solid(self, x: str) -> str:
        """Without white space."""
        return self.replace(x, f"{WS}+", "") if self.duck else f"translate({x}, {self.lit(WHITE)}, '')"

    def counted(self, xs: str) -> str:
        """Spark: the distinct strings of an array, ascending, with how often each stands there: structs (item, n). A sort and a scan
        for the places at which the item changes, within the row: nothing is exploded to be counted."""
        edges = "filter(sequence(0, size(s)), i -> i = 0 or i = size(s) or s[i] <> s[i - 1])"
        runs = self.let(edges, "b", "transform(slice(b, 1, size(b) - 1), (x, j) -> named_struct('item', s[x], 'n', cast(b[j + 1] - x as bigint)))")
        return self.let(f"sort_array({xs})", "s", runs)

    def single_spaced(self, x: str) -> str:
        """With one space for each run of white space; single spaces stay as they are, so they cost nothing."""
        return self.replace(x, f"{WS}+", " ") if self.duck else self.replace(self.spaces(x), " {2,}+", " ")

    def spaces(self, x: str) -> str:
        """With a space for each character of white space."""
        return self.translate(x, WHITE, " " * len(WHITE))

    def word_count(self, x: str) -> str:
        """Runs of what isn't white space."""
        return self.count(x, f"{NOT_WS}+") if self.duck else f"length({self.replace(f'trim({self.spaces(x)})', '[^ ]++ *+', 'w')})"

    def round_half_up(self, x: str) -> str:
        return f"cast(floor({x} + 0.5) as bigint)"

    def ratio(self, a: str, b: str) -> str:
        """A double; 0 where ``b`` is 0."""
        return f"case when {b} > 0 then cast({a} as double) / {b} else cast(0 as double) end"

    def list_sum(self, xs: str) -> str:
        return f"coalesce(list_sum({xs}), 0)" if self.duck else f"aggregate({xs}, cast(0 as bigint), (a, b) -> a + b)"


SPARK, DUCK = Dialect(), Dialect(duck=True)

#: White space as the text operators know it, and its complement.
_SPACES = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: The same, character by character.
WHITE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS, NOT_WS = f"[{_SPACES}]", f"[^{_SPACES}]"
#: NOT_WS said by what it holds, the most frequent ranges first: Java tries ranges one by one until one fits.
_INK = (
    r"[!-\x{9F}\x{A1}-\x{167F}\x{00}-\x{08}\x{0E}-\x{1F}\x{3001}-\x{FEFE}\x{2070}-\x{2FFF}\x{2010}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{206F}"
    r"\x{1681}-\x{1FFF}\x{200B}-\x{200F}\x{FF00}-\x{10FFFF}]"
)

"""Operator 7, BPE encoding and decoding with the vocabulary of a public tokenizer file.

A word is a doubly linked list of symbols. A priority queue holds the rank and
place of every pair that can merge; the least is taken again and again, and an
entry whose symbols have changed since it was queued is stale and skipped.
Decoding concatenates the strings of the vocabulary.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._common import add_columns, field, table

#: Words whose encoding a Python worker remembers; bounds its memory, never the result.
REMEMBERED = 150_000
#: Longer words are encoded anew each time.
LONGEST_REMEMBERED = 64

#: Marks of combining classes 1, 7, 9, 129, 202, 220, 230 and 240, beside which others are tried.
REFERENCE_MARKS = "\u0334\u093c\u094d\u0f71\u0321\u0316\u0300\u0345"
#: Unicode's White_Space.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"


#: The parts of a tokenizer file that this module does by its own means; a file that says otherwise is refused.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRETOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check_spec(spec: dict) -> None:
    """Raises ValueError where a tokenizer file asks for anything that isn't built here; truncation and padding are not used."""
    known = [
        ("normalizer", (spec.get("normalizer") or {}).get("normalizers"), NORMALIZERS),
        ("pre_tokenizer", (spec.get("pre_tokenizer") or {}).get("pretokenizers"), PRETOKENIZERS),
        ("decoder", spec.get("decoder"), None),
        ("post_processor", spec.get("post_processor"), None),
        ("model", {k: spec["model"].get(k) for k in MODEL}, MODEL),
        ("added_tokens", [{k: t.get(k) for k in ADDED} for t in spec.get("added_tokens", [])], [ADDED for _ in spec.get("added_tokens", [])]),
    ]
    for name, found, built in known:
        if found != built:
            raise ValueError(f"this tokenizer's {name} is not supported: {found!r}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable Latin-1, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def folded(text: str) -> str:
    """NFC and lower case, letter by letter: without the final form of a sigma."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@lru_cache(maxsize=1)
def odd_marks() -> frozenset[str]:
    """Code points that this Python and the tokenizers library order or compose otherwise, by trying: every mark before and after marks
    of low and high combining class, and every canonical decomposition. Made once for each Python worker that meets a text beyond
    ASCII."""
    import sys

    from tokenizers import normalizers

    library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
    differ = lambda s: folded(s) != library(s)
    odd = set()
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.category(c)[0] == "M" or unicodedata.combining(c):
            if any(differ(s) for other in REFERENCE_MARKS for s in (f"a{c}{other}", f"a{other}{c}")):
                odd.add(c)
        apart = unicodedata.decomposition(c)
        if apart and apart[0] != "<" and (differ(c) or differ(unicodedata.normalize("NFD", c))):
            odd |= {c, *unicodedata.normalize("NFD", c)[1:]}
    return frozenset(odd)


class WordBpe:
    """A byte-level BPE with word ends, as the file at ``path`` defines it."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        self.path, self._library = path, None
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.strings = {i: s for s, i in self.ids.items()}
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.parts = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.space = regex.compile(f"[{WHITE_SPACE}]+")
        self.word = regex.compile(WORD)
        shown = byte_characters()
        self.inner = [self.ids.get(c) for c in shown]
        self.last = [self.ids.get(c + self.end) for c in shown]
        self.known: dict[str, tuple[bytes, str, int]] = {}
        self.looked_up: set[str] = set()
        self.strange: set[str] = set()

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols of one word after all merges, least rank first and leftmost among equals."""
        n = len(symbols)
        merges = self.merges
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                found = merges.get((made, symbols[after]))
                if found:
                    heapq.heappush(queue, (found[0], i, found[1], made, symbols[after]))
            before = left[i]
            if before >= 0:
                found = merges.get((symbols[before], made))
                if found:
                    heapq.heappush(queue, (found[0], before, found[1], symbols[before], made))
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> tuple[bytes, str, int]:
        """The ids of a word as little-endian unsigned 32-bit integers, its decoded text, and how many ids there are."""
        raw = word.encode("utf-8")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        ids = self.merge([s for s in symbols if s is not None])
        packed = array("I", ids)
        return packed.tobytes(), " ".join([self.strings[i] for i in ids]), len(ids)

    def pieces(self, text: str):
        """(encoding, decoded text, count) of each word and special token of a text."""
        known = self.known
        for part, special in self._split(text):
            if special:
                yield array("I", [self.special[part]]).tobytes(), part, 1
                continue
            if part.isascii():
                words = self.word.findall(self.space.sub(" ", part).lower())
            elif self._strange(part):
                words = self._words_by_library(part)
            else:
                words = self.word.findall(self.space.sub(" ", folded(part)))
            for word in words:
                found = known.get(word)
                if found is None:
                    found = self.encode_word(word)
                    if len(word) <= LONGEST_REMEMBERED:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = found
                yield found

    def _strange(self, part: str) -> bool:
        """Whether a text holds code points on which Python and the library may differ; each is looked up once."""
        met = set(part)
        for c in met - self.looked_up:
            self.looked_up.add(c)
            if unicodedata.category(c) == "Cn" or c in odd_marks():
                self.strange.add(c)
        return not met.isdisjoint(self.strange)

    def _words_by_library(self, part: str) -> list[str]:
        """Words of a text with code points that this Python's Unicode table doesn't know, or orders and composes otherwise than the
        library's. The tables of the regex module and the library each have their own age; so the library's own normaliser and
        splitter decide here."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._bytes = {c: b for b, c in enumerate(byte_characters())}
        plain = self._library.normalizer.normalize_str(part)
        return [bytes(self._bytes[c] for c in word).decode("utf-8") for word, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]

    def _split(self, text: str):
        at = 0
        if self.parts is not None and any(s in text for s in self.special):
            for m in self.parts.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m.group(), True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join([p[0] for p in self.pieces(text)])).tolist()

    def decode(self, ids) -> str:
        """The strings of the vocabulary, one space between tokens: this tokenizer names no decoder."""
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One for each Python worker and path."""
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str | None = None, text_column: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The columns of ``docs`` (or those in ``keep``) with what ``outputs`` names: n_tokens (long), ids (little-endian unsigned
    32-bit integers, binary), decoded (the decoded text), ids_sha256 and decoded_sha256 (lowercase hex).

    Each row by itself, so repeated rows, ids and null ids need no care. A null text is encoded as an empty one: no
    tokens, no ids, an empty decoded text. Columns of ``docs`` with the name of an output are replaced. A tokenizer file with a
    normaliser, splitter, decoder or model other than those built here is a ValueError.
    """
    path = path or default_path()
    tokenizer(path)  # a file that isn't supported is an error here, not in a task
    kinds = {"n_tokens": T.LongType(), "ids": T.BinaryType(), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}

    def run(texts):
        import hashlib

        bpe = tokenizer(path)
        made = {k: [] for k in outputs}
        for text in texts:
            found = list(bpe.pieces(text.as_py()))
            ids = b"".join([p[0] for p in found])
            decoded = " ".join([p[1] for p in found])
            values = {"n_tokens": len(ids) // 4, "ids": ids, "decoded": decoded}
            for k in outputs:
                if k == "ids_sha256":
                    made[k].append(hashlib.sha256(ids).hexdigest())
                elif k == "decoded_sha256":
                    made[k].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                else:
                    made[k].append(values[k])
        return [made[k] for k in outputs]

    return add_columns(docs, text_column, [field(k, kinds[k]) for k in outputs], run, keep)


def decode_ids(rows: DataFrame, path: str | None = None, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text that the packed ids in ``ids_column`` stand for; null ids give null. Unknown ids are an error."""
    path = path or default_path()

    @F.pandas_udf(T.StringType())
    def run(column):
        bpe = tokenizer(path)
        return column.map(lambda b: None if b is None else bpe.decode(array("I", bytes(b))))

    return rows.withColumn(name, run(F.col(f"`{ids_column}`")))


def op7_bpe(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"), keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))

"""Names, codes and classes of single values: files, failures, statuses, ranges, pages."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import patterns as P
from quillspark.functions.dialect import WS, Dialect


def head(d: Dialect, x: str, n: int) -> str:
    return f"({x})[1:{n}]" if d.duck else f"substring({x}, 1, {n})"


def sanitize_title(d: Dialect, x: str) -> str:
    cut = head(d, d.trim(d.chain(x, ((r'[\\/:*?"<>|]', ""), (f"{WS}+", "_")))), 100)
    return f"coalesce(nullif({cut}, ''), 'untitled')"


def safe_name(d: Dialect, x: str, most: int = 200) -> str:
    """A storage name: anything but letters, digits, dot, dash and underscore becomes an underscore."""
    return head(d, d.replace(x, r"[^a-zA-Z0-9._\x{0600}-\x{06FF}-]", "_"), most)


def title_of_file(d: Dialect, x: str) -> str:
    return d.replace(x, r"(?i)\.(?:pdf|png|jpe?g)\z", "")


def content_disposition(d: Dialect, x: str) -> str:
    """An attachment header with an ASCII and a percent-encoded name."""
    plain = f"coalesce(nullif({d.trim(d.chain(x, ((r'[^\x20-\x7E]', '_'), (WS + '+', '_'))))}, ''), 'download')"
    if d.duck:
        encoded = f"url_encode({x})"
        for mark, code in (("!", "%21"),):
            encoded = f"replace({encoded}, '{code}', '{mark}')"
        for mark, code in (("(", "%28"), (")", "%29"), ("*", "%2A")):
            encoded = f"replace({encoded}, '{mark}', '{code}')"
        encoded = f"replace({encoded}, '''', '%27')"
    else:
        encoded = f"replace(replace(replace(replace(url_encode({x}), '+', '%20'), '%7E', '~'), '%21', '!'), '*', '%2A')"
    return f"concat('attachment; filename=\"', {plain}, '\"; filename*=UTF-8''''', {encoded})" if d.duck else f"concat('attachment; filename=\"', {plain}, '\"; filename*=UTF-8\\'\\'', {encoded})"


def redact(d: Dialect, x: str) -> str:
    """Error text without keys, tokens and hosts, 2000 characters at most."""
    return head(d, d.chain(x, P.SECRETS), 2000)


def _failure(d: Dialect, message: str, pick) -> str:
    cases = " ".join(f"when {' or '.join(d.contains(message, s) for s in subs)} then '{pick(category, code)}'" for subs, category, code in P.FAILURES)
    return f"case {cases} else '{pick(*P.OTHER_FAILURE)}' end"


def failure_category(d: Dialect, message: str) -> str:
    return _failure(d, message, lambda category, code: category)


def failure_code(d: Dialect, message: str) -> str:
    return _failure(d, message, lambda category, code: code)


def final_code(category: str, code: str, attempt: str, most: str) -> str:
    """What is reported once no retry is left."""
    return f"case when coalesce({attempt}, 1) >= coalesce({most}, 3) and {category} = 'transient' then 'RETRY_EXHAUSTED' else {code} end"


def backoff_ms(attempts: str, queue: str) -> str:
    """Base times two to the attempts: 5 s for OCR, else 2 s."""
    return f"cast(case when {queue} = 'ocr' then 5000 else 2000 end * power(2, {attempts}) as bigint)"


#: Progress in percent after each status.
PROGRESS = (("UPLOADED", 0), ("VALIDATING", 10), ("SPLITTING", 25), ("OCR_PROCESSING", 40), ("CLEANING", 65), ("GENERATING", 85), ("COMPLETED", 100))


def progress(status: str) -> str:
    return f"case {status} {' '.join(f'when {chr(39)}{s}{chr(39)} then {n}' for s, n in PROGRESS)} else 0 end"


def page_range(d: Dialect, ranges: str, most: str) -> str:
    """ "1,3-5" as the ascending numbers it names, up to ``most``; parts that are no range are passed over."""
    parts = d.map(d.split(ranges, ","), "p", d.trim("p"))
    good = d.filter(parts, "p", d.matches("p", r"^\d+(?:-\d+)?\z"))
    if d.duck:
        low, high = "cast(string_split(p, '-')[1] as bigint)", "cast(string_split(p, '-')[-1] as bigint)"
        spans = f"list_transform({good}, lambda p: case when {low} >= 1 and least({high}, {most}) >= {low} then range({low}, least({high}, {most}) + 1) else [] end)"
        return f"list_sort(list_distinct(flatten({spans})))"
    low, high = "cast(split(p, '-')[0] as bigint)", "cast(element_at(split(p, '-'), -1) as bigint)"
    spans = f"transform({good}, p -> if({low} >= 1 and least({high}, {most}) >= {low}, sequence({low}, least({high}, {most})), cast(array() as array<bigint>)))"
    return f"array_sort(array_distinct(flatten({spans})))"


def split_pages(d: Dialect, x: str, pages: str, separator: str = "===PAGE_BREAK===") -> str:
    """Exactly ``pages`` trimmed pages: missing ones are empty."""
    parts = d.split(x, separator)
    if d.duck:
        return f"list_transform(range(1, {pages} + 1), lambda i: {d.trim(f'coalesce({parts}[i], {chr(39)}{chr(39)})')})"
    return f"transform(sequence(1, {pages}), i -> {d.trim(f'coalesce(get({parts}, i - 1), {chr(39)}{chr(39)})')})"


def form_feed_pages(d: Dialect, x: str) -> str:
    return d.map(d.filter(d.split(x, "\f"), "p", "p <> ''"), "p", d.trim("p"))


def plain_text(d: Dialect, x: str) -> str:
    """Markdown as plain text: no front matter, heading marks, bold or links; bullets as dots."""
    return d.trim(
        d.chain(
            x,
            (
                (r"(?m)^---\n(?:[^\x00]*?)\n---\n", ""),
                (r"(?m)^### ", ""),
                (r"(?m)^## ", ""),
                (r"(?m)^# ", ""),
                (r"(?m)^- ", "• "),
                (r"\*\*(.+?)\*\*", "$1"),
                (r"\[(.+?)\]\(.+?\)", "$1"),
                (r"\n{3,}", "\n\n"),
            ),
        )
    )


#: Hosts that callbacks must not reach.
PRIVATE_HOST = r"^(?:localhost\z|127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[0-1])\.|::1\z)|\.local\z|\.internal\z"


def safe_url(d: Dialect, x: str) -> str:
    host = f"lower(regexp_extract({x}, {d.lit('^[a-zA-Z]+://(?:[^/@]*@)?' + chr(92) + '[?([^/?#:]+)')}, 1))"
    return f"({d.matches(x, r'^(?i:https?)://[^/?#]')} and not {d.matches(host, PRIVATE_HOST)})"


def route(d: Dialect, mime: str, name: str) -> str:
    """How a file is taken in, by MIME type and name."""
    ends = lambda *xs: d.matches(f"lower({name})", r"\.(?:" + "|".join(xs) + r")\z")
    office = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    return (
        f"case when {mime} = 'application/pdf' or {ends('pdf')} then 'pdf' when {d.starts(mime, 'image/')} or {ends('png', 'jpg', 'jpeg', 'tiff?', 'bmp', 'webp')} then 'image'"
        f" when {mime} = '{office}' or {ends('docx')} then 'docx' when {mime} in ('text/plain', 'text/markdown') or {ends('txt', 'md')} then 'txt' else 'unknown' end"
    )


def file_error(mime: str, content: str, most: int = 100 * 1024 * 1024) -> str:
    """Spark SQL: why a file (binary ``content``) is refused, or null."""
    start = f"hex(substring({content}, 1, 4))"
    first, last = f"decode(substring({content}, 1, 20), 'ISO-8859-1')", f"rtrim(decode(substring({content}, greatest(octet_length({content}) - 19, 1), 20), 'ISO-8859-1'))"
    return (
        f"case when {mime} not in ('application/pdf', 'image/png', 'image/jpeg') then 'INVALID_TYPE' when octet_length({content}) > {most} then 'FILE_TOO_LARGE'"
        f" when {mime} = 'image/jpeg' then case when {start} not like 'FFD8FF%' then 'IMAGE_CORRUPT' end"
        f" when {mime} = 'image/png' then case when {start} <> '89504E47' then 'IMAGE_CORRUPT' end"
        f" when octet_length({content}) < 20 then 'PDF_MALFORMED' when trim({first}) not rlike '^%PDF-[0-9]' then 'PDF_CORRUPT'"
        f" when {last} not rlike '%%EOF' then 'PDF_TRUNCATED' when decode(substring({content}, 1, 8192), 'ISO-8859-1') rlike '/Encrypt' then 'PDF_ENCRYPTED' end"
    )


def provider_score(success: str, latency_ms: str, failures: str, state: str) -> str:
    """Adaptive order of providers: better success, lower latency, fewer failures in a row; open ones come last."""
    return f"case when {state} = 'open' then cast('-Infinity' as double) when {success} is null then cast(1 as double) else greatest(cast(0 as double), {success} * (1 - least({latency_ms} / 10000.0, 1.0)) - 0.1 * {failures}) end"


def sign(secret: str):
    """HMAC-SHA256 of payloads, hex; Spark has no such function."""
    key = secret.encode()

    @F.pandas_udf(T.StringType())
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda p: hmac.new(key, p.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return run


def prometheus_line(d: Dialect, name: str, labels: str, value: str) -> str:
    return f"concat('{name}{{', {labels}, '}} ', cast({value} as varchar))" if d.duck else f"concat('{name}{{', {labels}, '}} ', cast({value} as string))"

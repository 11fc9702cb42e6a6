"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences that publishers add, and query parameters that only track.
BOILERPLATE = r"(?i)\b(follow us|subscribe|sign up|newsletter|cookie|cookies|privacy policy|terms of service|advertisement|sponsored|all rights reserved|share this|click here|download our app)\b"
TRACKING = r"^(utm_|gclid|fbclid|mc_|_ga|ref_src)"
ELLIPSIS = "…"
# Where sentences part, and how texts name tickers.
SENTENCE_END = r"(?<=[\.\!\?])\s+(?=[A-Z\$0-9])"
CASHTAG = r"\$([A-Z]{1,6})\b"
PAREN_TICKER = r"\(\s*(?:(?:NASDAQ|NYSE(?:AMERICAN)?|AMEX|OTC|LSE|TSX|HKEX|SSE|SZSE|FRA|ETR|BIT|BME|EPA|BIST)\s*:\s*)?([A-Z]{1,6}(?:\.[A-Z])?)\s*\)"


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def whole_word(term: str) -> str:
    """A pattern for ``term`` not next to ASCII letters or digits, in lower-case text."""
    return rf"(?<![a-z0-9])\Q{term}\E(?![a-z0-9])"


def has_keyword(text: Column, keyword: str) -> Column:
    """Whole-word match of a keyword of letters, digits and spaces; other keywords match anywhere."""
    k = keyword.strip().lower()
    if not k.replace(" ", "").isalnum():
        return F.contains(text, F.lit(k))
    # The cheap search decides most rows before the pattern runs.
    return F.contains(text, F.lit(k)) & text.rlike(whole_word(k))


def matched(text: Column, keywords: list[str] | tuple[str, ...]) -> Column:
    """The keywords that match, in their order."""
    return F.filter(F.array(*(F.when(has_keyword(text, k), F.lit(k)) for k in keywords)), lambda x: x.isNotNull())


def title_tokens(title: Column, stopwords: frozenset[str] | list[str]) -> Column:
    words = F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9']+)"), 1)
    return F.array_except(words, F.array(*map(F.lit, sorted(stopwords))))


def sentences(text: Column, longest: int = 400) -> Column:
    """Distinct sentences without boilerplate; long ones are cut at a word and end in an ellipsis."""
    parts = F.transform(F.split(strip(F.coalesce(text, F.lit(""))), SENTENCE_END), strip)
    kept = F.filter(parts, lambda s: (s != "") & ~s.rlike(BOILERPLATE))
    clip = lambda s: F.when(F.length(s) > longest, F.concat(F.regexp_replace(F.substring(s, 1, longest), r" [^ ]*$", ""), F.lit(ELLIPSIS))).otherwise(s)
    return F.array_distinct(F.transform(kept, clip))


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CASHTAG), 1)


def paren_tickers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PAREN_TICKER), 1)


def domain_of(url: Column, fallback: Column | None = None) -> Column:
    """Host of a URL in lower case without a leading www."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.coalesce(F.when(host != "", host), fallback) if fallback is not None else F.when(host != "", host)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no www., no trailing slash, no fragment, no tracking parameters; what isn't a URL stays."""
    raw = strip(F.coalesce(url, F.lit("")))
    scheme, host = F.try_parse_url(raw, F.lit("PROTOCOL")), F.try_parse_url(raw, F.lit("AUTHORITY"))
    path = F.coalesce(F.try_parse_url(raw, F.lit("PATH")), F.lit(""))
    kept = F.filter(F.split(F.coalesce(F.try_parse_url(raw, F.lit("QUERY")), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(F.lower(scheme), F.lit("://"), F.regexp_replace(F.lower(host), r"^www\.", ""), F.regexp_replace(path, "/+$", ""), query)
    return F.coalesce(whole, raw)


def normal_title(title: Column) -> Column:
    """Lower case, one trailing " - Source" off, punctuation as spaces; with under five characters besides spaces it is empty."""
    low = strip(F.regexp_replace(F.lower(strip(F.coalesce(title, F.lit("")))), "\\s+[-|\u2013\u2014]\\s+[^-|\u2013\u2014]{1,40}$", ""))
    plain = strip(F.regexp_replace(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))
    return F.when(F.length(F.replace(plain, F.lit(" "), F.lit(""))) < 5, "").otherwise(plain)


def csv_safe(x: Column) -> Column:
    """A leading quote before what a spreadsheet would take for a formula."""
    return F.when(x.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), x)).otherwise(x)


def plain_html(text: Column) -> Column:
    """Tags as spaces, the common references decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style|noscript|iframe|object|embed)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
    decoded = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, bare)
    return strip(F.regexp_replace(decoded, r"\s+", " "))


def sampled(key: Column, rate: float) -> Column:
    """True for a fixed share of keys: eight hex digits of the SHA-256, modulo ten thousand, below the rate."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 10_000 < int(rate * 10_000)


def cluster_id(ids: Column) -> Column:
    return F.sha1(F.array_join(F.array_sort(ids), "|"))


def safe_tag(tag: Column) -> Column:
    """The stripped tag if it has 1 to 50 of the allowed characters, else null."""
    t = strip(tag)
    return F.when(t.rlike(r"^[a-zA-Z0-9_.\-]{1,50}$"), t)


def equity_shaped(ticker: Column) -> Column:
    return ticker.rlike(r"^[A-Z.]{1,8}$")

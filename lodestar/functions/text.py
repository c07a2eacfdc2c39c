"""Scalar functions on texts, URLs and dates, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a Unicode-aware strip removes, the four separators included that Java's class leaves out.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
TERM = "[a-z0-9]{3,}"
SHARDS = 64


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str) -> Column:
    """Lower-case runs of at least three ASCII letters or digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TERM), F.lit(0))


def terms(text: Column | str) -> Column:
    return F.array_distinct(tokenize(text))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), f"^{_SPACE}+|{_SPACE}+$", "")


def collapse(text: Column | str) -> Column:
    """Runs of white space become one space; none is left at the ends."""
    return strip(F.regexp_replace(_col(text), f"{_SPACE}+", " "))


def first_tokens(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, n), " ")


def domain_of(url: Column | str) -> Column:
    """Lower-case host without user, port and one leading ``www.``; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(_col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^\[|\]$", ""), r"^www\.", "")


def normalize_domain(domain: str) -> str:
    """The same for a domain that a caller names."""
    return domain.strip().lower().removeprefix("www.")


def month_key(date: Column | str) -> Column:
    """``YYYY-MM`` of a date string; empty where it does not begin with a valid month."""
    return F.regexp_extract(F.coalesce(_col(date), F.lit("")), r"^(\d{4}-(?:0[1-9]|1[0-2]))", 1)


def title_from_url(url: Column | str) -> Column:
    """A heading from the last path segment: decoded, without its extension, words capitalised.

    Empty for a missing segment, or for one unbroken segment of over 60 characters.
    """
    path = F.regexp_replace(F.regexp_replace(F.coalesce(_col(url), F.lit("")), r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    raw = F.regexp_extract(path, r"([^/]*)$", 1)
    # A plus is no space here, and a stray percent sign leaves the segment as it is.
    tail = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    base = F.regexp_replace(F.regexp_replace(tail, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""), r"\.[^.]*$", "")
    words = F.filter(F.split(F.regexp_replace(base, r"[_\-/]", " "), r"\s+"), lambda w: w != "")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    unbroken = (F.size(words) == 1) & (F.element_at(words, 1) == base) & (F.length(base) > 60)
    return F.when((F.size(words) == 0) | unbroken, F.lit("")).otherwise(titled)


def payload_id(payload: Column | str) -> Column:
    """``sha1:`` and the hex SHA-1 of a record's raw bytes."""
    return F.concat(F.lit("sha1:"), F.sha1(_col(payload)))


def record_digest(x: Column | str) -> Column:
    return F.sha2(_col(x).cast("binary"), 256)


def shard_of(key: Column | str, shards: int = SHARDS) -> Column:
    """Shard of a store key: the first 32 bits of its SHA-1 modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.sha1(F.encode(_col(key).cast("string"), "utf-8")), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int")


def sanitize(text: Column | str) -> Column:
    """Without control, format and surrogate characters, tab and newline kept; null becomes empty."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"[\p{Cc}\p{Cf}\p{Cs}&&[^\t\n]]", "")


def ascii_ratio(text: Column | str) -> Column:
    """Share of ASCII code points; an empty text counts as one character long."""
    t = F.coalesce(_col(text), F.lit(""))
    return F.length(F.regexp_replace(t, r"[^\x00-\x7F]", "")) / F.greatest(F.lit(1), F.length(t))


def archive_to_text_path(path: Column | str) -> Column:
    """The first ``/warc/`` of a path becomes ``/wet/``; a path without it is an error."""
    p = _col(path)
    made = F.regexp_replace(p, r"^(.*?)/warc/", "$1/wet/")
    return F.when(F.instr(p, "/warc/") > 0, made).otherwise(F.raise_error(F.concat(F.lit("no /warc/ in path: "), F.coalesce(p, F.lit("null")))).cast("string"))


def ratio(hits: Column | str, n: Column | str) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(_col(hits).cast("double"), _col(n).cast("double")), F.lit(0.0))


def hit_at(position: Column | str, k: int = 10) -> Column:
    return F.coalesce(_col(position).between(1, k), F.lit(False)).cast("int")


def reciprocal_at(position: Column | str, k: int = 10) -> Column:
    p = _col(position)
    return F.when(p.between(1, k), F.lit(1.0) / p).otherwise(0.0)


def knob_slug(*pairs: tuple[str, Column]) -> Column:
    """``np8_tc50_pt64_b32`` from (letters, value) pairs."""
    return F.concat_ws("_", *(F.concat(F.lit(k), v.cast("string")) for k, v in pairs))


def best_first(score: Column | str) -> Column:
    """Order by score, largest first; NaN and null last."""
    s = _col(score).cast("double")
    return F.when(F.isnan(s), F.lit(None)).otherwise(s).desc_nulls_last()

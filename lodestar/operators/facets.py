"""Facets of documents (domain, month, terms) and filters on them.

Values of one dimension: domains are OR, terms are AND, a month range is inclusive. Dimensions are AND. A dimension that
is not named does not filter; one named with an empty list matches nothing. Predicates are columns, so they reach the
scan before any ranking.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

MAX_TERMS, MAX_LIST = 50_000, 1000
FACETS = ("domains", "dates", "terms")


def facet_columns(docs: DataFrame, url: str = "url", date: str = "date", text: str = "text") -> DataFrame:
    """``docs`` with domain and month (null where there is none) and terms (array, distinct)."""
    blank = lambda c: F.when(c != "", c)
    return docs.withColumns({"domain": blank(X.domain_of(url)), "month": blank(X.month_key(date)), "terms": F.coalesce(X.terms(text), F.array().cast("array<string>"))})


def document_frequency(docs: DataFrame, terms: Column | str = "terms") -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    t = F.col(terms) if isinstance(terms, str) else terms
    return docs.select(F.explode(t).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(docs: DataFrame, max_terms: int = MAX_TERMS, terms: Column | str = "terms") -> DataFrame:
    """The ``max_terms`` terms of the largest document frequency, ties by term: a bounded top-k, not a full sort."""
    return document_frequency(docs, terms).orderBy(F.desc("df"), "term").limit(max_terms)


def postings(faceted: DataFrame, vocabulary: DataFrame, row: str = "row_id") -> DataFrame:
    """(facet, key, row_id): a row for each value that a document holds; terms only of the vocabulary.

    Long form: a frequent key has many rows, never one huge array, and the vocabulary is bounded, so its join
    may broadcast it.
    """
    r = F.col(row).alias("row_id")
    domains = faceted.filter("domain is not null").select(F.lit("domains").alias("facet"), F.col("domain").alias("key"), r)
    dates = faceted.filter("month is not null").select(F.lit("dates").alias("facet"), F.col("month").alias("key"), r)
    terms = faceted.select(F.explode("terms").alias("key"), r).join(vocabulary.select(F.col("term").alias("key")), "key", "left_semi").select(F.lit("terms").alias("facet"), "key", "row_id")
    return domains.unionByName(dates).unionByName(terms)


def facet_stats(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: distinct domains, dates and terms, and the number of documents."""
    keys = posted.groupBy("facet", "key").count().groupBy("facet").count()
    pick = lambda f: F.coalesce(F.max(F.when(F.col("facet") == f, F.col("count"))), F.lit(0)).cast("long").alias(f)
    return keys.agg(*map(pick, FACETS)).crossJoin(docs.agg(F.count(F.lit(1)).alias("n_docs")))  # one row each


def max_rows(posted: DataFrame) -> DataFrame:
    return posted.groupBy("facet", "key").agg(F.max("row_id").alias("max_row"), F.count(F.lit(1)).alias("n"))


def row_space_violations(posted: DataFrame, n_docs: int) -> DataFrame:
    """Keys whose postings name a row outside 0 to n_docs - 1."""
    return max_rows(posted).filter((F.col("max_row") >= n_docs) | (F.col("max_row") < 0))


@dataclass(frozen=True)
class Filter:
    """None: the dimension does not filter. ``allow`` are row ids in any order; repeats and unknown ones do no harm."""

    domains: list[str] | None = None
    month_range: tuple[str, str] | None = None
    terms: list[str] | None = None
    allow: list[int] | None = None

    def is_empty(self) -> bool:
        return self.domains is None and self.month_range is None and self.terms is None and self.allow is None

    def column(self, row: str = "row_id", vocabulary: list[str] | None = None) -> Column | None:
        """The predicate on (row, domain, month, terms), or None where nothing filters.

        A term outside the vocabulary, where one is given, matches nothing.
        """
        parts: list[Column] = []
        if self.domains is not None:
            names = sorted({X.normalize_domain(d) for d in self.domains})
            parts.append(F.col("domain").isin(names) if names else F.lit(False))
        if self.month_range is not None:
            parts.append(F.col("month").between(*self.month_range))
        if self.terms is not None:
            wanted = sorted({t.lower() for t in self.terms})
            known = wanted and (vocabulary is None or set(wanted) <= set(vocabulary))
            parts.append(F.forall(F.array(*map(F.lit, wanted)), lambda t: F.array_contains(F.col("terms"), t)) if known else F.lit(False))
        if self.allow is not None:
            parts.append(F.col(row).isin(sorted(set(self.allow))) if self.allow else F.lit(False))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return None if out is None else F.coalesce(out, F.lit(False))


def or_keys(posted: DataFrame, facet: str, keys: list[str]) -> DataFrame:
    """Rows that hold any of the keys."""
    return posted.filter((F.col("facet") == facet) & F.col("key").isin(keys)).select("row_id").distinct() if keys else posted.select("row_id").limit(0)


def and_keys(posted: DataFrame, facet: str, keys: list[str]) -> DataFrame:
    """Rows that hold all of the keys; none for no keys."""
    keys = sorted(set(keys))
    if not keys:
        return posted.select("row_id").limit(0)
    return posted.filter((F.col("facet") == facet) & F.col("key").isin(keys)).distinct().groupBy("row_id").count().filter(F.col("count") == len(keys)).select("row_id")


def resolve(posted: DataFrame, f: Filter) -> DataFrame | None:
    """Row ids by the postings alone: the intersection of the dimensions, or None where nothing filters."""
    parts = []
    if f.domains is not None:
        parts.append(or_keys(posted, "domains", [X.normalize_domain(d) for d in f.domains]))
    if f.month_range is not None:
        lo, hi = f.month_range
        parts.append(posted.filter((F.col("facet") == "dates") & F.col("key").between(lo, hi)).select("row_id").distinct())
    if f.terms is not None:
        parts.append(and_keys(posted, "terms", [t.lower() for t in f.terms]))
    if f.allow is not None:
        parts.append(posted.sparkSession.createDataFrame([(int(i),) for i in sorted(set(f.allow))], "row_id long"))
    out = None
    for p in parts:
        out = p if out is None else out.intersect(p)
    return out


_NAMES = {"date_range": "month_range", "keywords": "terms"}


def month_bound(value: object, which: str) -> str:
    """``YYYY-MM`` of a date that a caller gives; ValueError for anything else."""
    if not isinstance(value, str):
        raise ValueError(f"{which} of the date range is not a string: {value!r}")  # noqa: TRY004
    m = value[:7]
    if len(m) != 7 or m[4] != "-" or not (m[:4] + m[5:]).isdigit() or not 1 <= int(m[5:]) <= 12:
        raise ValueError(f"{which} of the date range is not a month: {value!r}")
    return m


def month_range(value: object) -> tuple[str, str]:
    if isinstance(value, str | bytes) or not isinstance(value, list | tuple) or len(value) != 2:
        raise ValueError(f"a date range is a pair of dates, not {value!r}")
    return month_bound(value[0], "start"), month_bound(value[1], "end")


def translate_filters(filters: dict | None) -> Filter:
    """A checked Filter from a caller's dict; ``date_range`` and ``keywords`` are other names. ValueError if malformed."""
    out: dict = {}
    for name, value in (filters or {}).items():
        key = _NAMES.get(name, name)
        if key == "month_range":
            value = month_range(value)
        elif key in ("domains", "terms", "allow"):
            kind = int if key == "allow" else str
            if not isinstance(value, list) or not all(isinstance(x, kind) for x in value):
                raise ValueError(f"filter {key} must be a list of {kind.__name__}")
            if len(value) > MAX_LIST:
                raise ValueError(f"filter {key} has {len(value)} entries, over {MAX_LIST}")
        else:
            raise ValueError(f"unknown filter {name!r}")
        out[key] = value
    return Filter(**out)

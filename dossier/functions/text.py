"""Scalar functions on text, numbers, keys, hashes and JSON, as Column expressions.

Patterns use explicit classes of letters and digits, so Spark and SQL oracles agree.
The two that need Unicode composition or case folding are Arrow functions, meant to run
once at the source.
"""

from __future__ import annotations

import unicodedata
import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ways of writing a missing value, compared without regard to case.
MISSING = ("", "--", "null", "none", "n/a")
# The written form of a document number, and what may stand around it.
NUMBER = r"\d{1,4}\s*/\s*(?:\d{4}\s*/\s*)?[A-ZĐ][A-ZĐ0-9]*(?:\s*-\s*[A-ZĐ0-9]+)*"
NUMBER_PATTERN = rf"(?iu)(?<![\p{{L}}\p{{N}}_])({NUMBER})(?![\p{{L}}\p{{N}}_])"
# What a mention does, the first that occurs near it; else it cites.
MENTION_KINDS = (("repeals", r"bãi\s+bỏ"), ("replaces", r"thay\s+thế"), ("amends", r"sửa\s+đổi|bổ\s+sung"))
SEPARATOR = "\u001f"


def text(c) -> Column:
    """Runs of white space become one blank, none at the ends; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?U)\s+", " "))


def optional(c) -> Column:
    """``text``, with '' for every way of writing a missing value."""
    tidy = text(c)
    return F.when(F.lower(tidy).isin(*MISSING), "").otherwise(tidy)


def date(c) -> Column:
    """ISO date of d/m/yyyy or yyyy-m-d; other text unchanged."""
    tidy = optional(c)
    first = F.when(tidy.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(tidy, "d/M/yyyy"))
    second = F.when(tidy.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(tidy, "yyyy-M-d"))
    return F.coalesce(F.date_format(first, "yyyy-MM-dd"), F.date_format(second, "yyyy-MM-dd"), tidy)


def iso_date(c) -> Column:
    """The value if it is a real ISO date, else ''."""
    value = F.coalesce(_c(c), F.lit(""))
    real = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    return F.coalesce(F.date_format(real, "yyyy-MM-dd"), F.lit(""))


def number_norm(c) -> Column:
    """A composed document number in its normal form (see ``compose`` for uncomposed input)."""
    value = F.upper(F.coalesce(_c(c), F.lit("")))
    value = F.regexp_replace(value, r"^[ .,;:()\[\]]+|[ .,;:()\[\]]+$", "")
    return F.regexp_replace(value, r"(?U)\s+", "")


@F.pandas_udf(T.StringType())
def compose(values: pd.Series) -> pd.Series:
    """NFC; null stays null."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def entity_key(values: pd.Series) -> pd.Series:
    """NFC, case-folded, single blanks; null becomes ''."""
    return values.map(lambda v: "" if v is None else " ".join(unicodedata.normalize("NFC", v).casefold().split()))


@F.pandas_udf(T.StringType())
def point_id(values: pd.Series) -> pd.Series:
    """Name-based UUID (version 5) of a chunk id."""
    return values.map(lambda v: None if v is None else str(uuid.uuid5(uuid.NAMESPACE_URL, v)))


def fingerprint(*columns) -> Column:
    """SHA-256 of the columns, null as '', with a separator between them."""
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns)), 256)


def index_hash(version: str, document_hash, model: str, size: int, overlap: int) -> Column:
    """Changes if the document, the embedding model or the chunking changes."""
    return F.sha2(F.concat_ws("|", F.lit(version), _c(document_hash), F.lit(model), F.lit(str(size)), F.lit(str(overlap))), 256)


def chunk_body(c) -> Column:
    """A chunk's text without the three generated header lines."""
    return F.regexp_replace(_c(c), r"(?s)^.*?\nSố hiệu: [^\n]*\nMục: [^\n]*\n", "")


def article_id(document, section) -> Column:
    """``document:article:n`` if the section is exactly an article heading, else ''."""
    number = F.regexp_extract(_c(section), r"(?iu)^Điều\s+(\d+[a-zđ]?)$", 1)
    return F.when(number != "", F.concat(_c(document), F.lit(":article:"), F.lower(number))).otherwise("")


def body_text(c) -> Column:
    """Composed text with straight quotes, no blanks around quotes, escapes as blanks."""
    value = F.translate(compose(F.coalesce(_c(c), F.lit(""))), "“”‘’", "\"\"''")
    value = F.regexp_replace(value, r"\\[ntr]", " ")
    return text(F.regexp_replace(value, r"\s*([\"'])\s*", "$1"))


def model_json(c) -> Column:
    """A response's JSON: all of it, or the one fenced block at its end; else null."""
    raw = F.trim(F.coalesce(_c(c), F.lit("")))
    fences = F.size(F.regexp_extract_all(raw, F.lit("(```)"), F.lit(1)))
    inner = F.trim(F.regexp_extract(raw, r"(?s)^.*```(?:json)?\s*(.*?)\s*```$", 1))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull() & x.rlike(r"^\s*[\[{]"), x)
    return F.coalesce(valid(raw), F.when((fences == 2) & (inner != ""), valid(inner)))


def resolve_alias(c, aliases: dict[str, str]) -> Column:
    """The name behind an alias, '' if unknown."""
    if not aliases:
        return F.lit("")
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(known[F.coalesce(_c(c), F.lit(""))], F.lit(""))


def filters(**values) -> Column:
    """Conjunction of the equalities whose value isn't empty; always true without any."""
    terms = [F.col(k) == v for k, v in values.items() if v not in (None, "")]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def condition(tree: dict) -> Column:
    """A filter tree of ``must``, ``should``, ``must_not`` and {key, match|any|gte|lte} leaves."""
    if "key" in tree:
        column, parts = F.col(tree["key"]), []
        if "match" in tree:
            parts.append(column == tree["match"])
        if "any" in tree:
            parts.append(column.isin(list(tree["any"])))
        if "gte" in tree:
            parts.append(column >= tree["gte"])
        if "lte" in tree:
            parts.append(column <= tree["lte"])
        if not parts:
            raise ValueError("a condition needs match, any, gte or lte")
        return reduce(lambda a, b: a & b, parts)
    unknown = set(tree) - {"must", "should", "must_not"}
    if unknown:
        raise ValueError(f"unknown filter parts: {sorted(unknown)}")
    out = F.lit(True)
    for part in tree.get("must", []):
        out = out & condition(part)
    if tree.get("should"):
        out = out & reduce(lambda a, b: a | b, map(condition, tree["should"]))
    for part in tree.get("must_not", []):
        out = out & ~F.coalesce(condition(part), F.lit(False))
    return out


def merge_json(left, right) -> Column:
    """Two flat JSON objects as one; the right one's entries win."""
    kind = "map<string,string>"
    a, b = F.from_json(_c(left), kind), F.from_json(_c(right), kind)
    kept = F.map_filter(F.coalesce(a, F.create_map().cast(kind)), lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
    return F.to_json(F.map_concat(kept, F.coalesce(b, F.create_map().cast(kind))))


def words(c) -> Column:
    """Lower-case words: letters and digits, joined by single hyphens or apostrophes."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*"), F.lit(0))


def ngrams(c, n: int) -> Column:
    """The runs of ``n`` words of one field."""
    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda k: F.array_join(F.slice(w, k, n), " "))
        return F.when(F.size(w) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(words(c), runs)


def token_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_c(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def token_overlap(question, passage) -> Column:
    """Share of the question's distinct tokens that the passage holds."""
    q = token_set(question)
    return F.size(F.array_intersect(q, token_set(passage))) / F.greatest(F.lit(1), F.size(q))


def citations(answer, allowed) -> Column:
    """Struct of the source labels an answer cites: ``valid`` and ``invalid`` against ``allowed``."""
    said = F.array_sort(F.array_distinct(F.regexp_extract_all(_c(answer), F.lit(r"\[(S\d+)\]"), F.lit(1))))
    return F.struct(F.array_intersect(said, _c(allowed)).alias("valid"), F.array_except(said, _c(allowed)).alias("invalid"))


def nearest_rank(values, share: float) -> Column:
    """Nearest-rank percentile of a group's values."""
    return F.percentile_disc(share).within_group(_c(values)) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {values})")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once; a plain lambda body would compute it for each element."""
    return F.transform(F.array(value), use)[0]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c

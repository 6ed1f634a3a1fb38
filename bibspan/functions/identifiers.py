"""Column expressions that find and normalise persistent identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, NULL without one; the pattern is evaluated once."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def normalized_doi(raw: Column) -> Column:
    """`doi:` id of the first DOI in the text, NULL when there is none."""
    return F.concat(F.lit("doi:"), F.lower(first_match(raw, fixed.DOI_PATTERN)))


def normalized_pmid(raw: Column) -> Column:
    """`pmid:` id of the first PMID, NULL for PMC ids and for texts without one."""
    digits = first_match(raw, fixed.PMID_PATTERN, 1)
    return F.when(~raw.contains(fixed.PMC_MARK), F.concat(F.lit("pmid:"), digits))


def normalized_isbn(raw: Column) -> Column:
    """`isbn:` id of the first 13- or 10-digit ISBN; a label inside the match stays in the id."""
    compact = F.regexp_replace(first_match(raw, fixed.ISBN_PATTERN), fixed.ISBN_SEPARATORS, "")
    return F.concat(F.lit("isbn:"), F.lower(compact))


def row_if_present(value: Column) -> Column:
    """Generator of one row for a value and of none for NULL.

    A filter on a computed column is pushed below the projection and computes the
    value again; a generator drops the same rows and computes it once.
    """
    return F.explode(F.array_compact(F.array(value)))


def scheme(pid: Column) -> Column:
    """`doi`, `pmid` or `isbn`; NULL for anything else."""
    return F.regexp_substr(pid, F.lit(fixed.SCHEME_PATTERN))


def scheme_key(pid: Column) -> Column:
    """First four characters, the short form used in the scheme counts."""
    return F.substring(pid, 1, 4)


def scheme_rank(pid: Column) -> Column:
    """Position of the id's scheme in the order of preference."""
    rank = F.lit(len(fixed.SCHEMES))
    for position, name in enumerate(fixed.SCHEMES):
        rank = F.when(pid.startswith(name + ":"), position).otherwise(rank)
    return rank


def type_priority(pid: Column, type_code: Column) -> Column:
    """Priority of an item for a shared id; codes without one, and no code, come last."""
    last = F.lit(1 + max(max(p.values()) for p in fixed.TYPE_PRIORITY.values()))
    result = last
    for name, priority in fixed.TYPE_PRIORITY.items():
        known = last
        for code, value in priority.items():
            known = F.when(type_code == code, value).otherwise(known)
        result = F.when(pid.startswith(name + ":"), known).otherwise(result)
    return result

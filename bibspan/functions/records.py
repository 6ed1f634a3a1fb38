"""Column expressions over records of the global metadata table and over item texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed
from bibspan.functions.identifiers import first_match


def _id_of_scheme(id_list: Column, mark: str, pattern: str) -> Column:
    """First id of a scheme; the cheap text search spares most records the pattern."""
    return F.when(id_list.contains(mark), first_match(id_list, pattern))


def omid(id_list: Column) -> Column:
    return first_match(id_list, fixed.META_OMID_PATTERN)


def canonical_id(id_list: Column) -> Column:
    """The record's DOI, else its PMID, else its ISBN; only this one takes part in matching."""
    return F.coalesce(
        _id_of_scheme(id_list, "doi:", fixed.META_DOI_PATTERN),
        _id_of_scheme(id_list, "pmid:", fixed.META_PMID_PATTERN),
        _id_of_scheme(id_list, "isbn:", fixed.META_ISBN_PATTERN),
    )


def type_preference(meta_type: Column, type_code: Column) -> Column:
    """Preference of a record whose type fits the item's type, NULL when it does not."""
    result = F.lit(None).cast("int")
    for name, code, value in fixed.TYPE_PREFERENCE:
        result = F.when((meta_type == name) & (type_code == code), value).otherwise(result)
    return result


def named_blank(text: Column, label: str = fixed.NO_TYPE_LABEL) -> Column:
    """Label an empty text; NULL stays NULL."""
    return F.when(text == "", label).otherwise(text)


def clean_title(title: Column) -> Column:
    spaced = F.replace(title, F.lit("\r"), F.lit(" "))
    joined = F.replace(spaced, F.lit("\n"), F.lit(""))
    return F.replace(joined, F.lit('"'), F.lit("'"))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, whatever the kind of whitespace."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda word: word != ""))


def entity_omid(address: Column) -> Column:
    return F.replace(address, F.lit(fixed.ENTITY_ADDRESS), F.lit(fixed.OMID_PREFIX))


def author_line(authors: Column) -> Column:
    """"given family, given family", for authors that have a family name.

    A missing given name leaves its blank in place.
    """
    kept = F.filter(authors, lambda a: a["family"].isNotNull())
    names = F.transform(
        kept, lambda a: F.concat(F.coalesce(a["given"], F.lit("")), F.lit(" "), a["family"])
    )
    return F.array_join(names, ", ")


def year_text(date: Column) -> Column:
    """First run of four digits in a free-form date."""
    return F.regexp_substr(date, F.lit(fixed.YEAR_PATTERN))


def year_number(year: Column) -> Column:
    return year.try_cast("int")


def year_of_issue(year: Column) -> Column:
    """Year of the date 1 January of that year, so that only calendar years pass."""
    return F.year(F.make_date(year, F.lit(1), F.lit(1)))


def percent(part: Column, whole: Column) -> Column:
    return F.round(part * F.lit(100) / whole, 2)


def bibliographic_text(title: Column, authors: Column) -> Column:
    """Search text of an item: its title, then its authors when known."""
    return F.concat(title, F.coalesce(F.concat(F.lit(", "), authors), F.lit("")))


def words(text: Column) -> Column:
    """Distinct lower-case words of a text, in order."""
    parts = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.sort_array(F.array_remove(parts, ""))


def words_key(word_list: Column) -> Column:
    """Key of a list of words: equal for equal lists, and short however long the text."""
    return F.sha2(F.array_join(word_list, " "), 256)

"""Unit tables of the column expressions."""

import pytest
from pyspark.sql import functions as F

from bibspan.functions import identifiers, records


def value(spark, expression, schema, *row):
    return spark.createDataFrame([row], schema).select(expression).first()[0]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("https://doi.org/10.1000/AbC.6; see note", "doi:10.1000/abc.6"),
        ("n/a", None),
        ("", None),
        (None, None),
        ("10.1234/a b", "doi:10.1234/a"),
        ("10.123/x", None),
        ("10.1234/", "doi:10.1234/"),
        ("10.1234/a, 10.5678/b", "doi:10.1234/a"),
    ],
)
def test_doi(spark, raw, expected):
    assert value(spark, identifiers.normalized_doi(F.col("c")), "c string", raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("PMID: 00123456", "pmid:123456"),
        ("7", None),
        ("0012", "pmid:12"),
        ("1234567890", "pmid:123456789"),
        ("PMC123", None),
        ("pmc123", "pmid:123"),
        (None, None),
    ],
)
def test_pmid(spark, raw, expected):
    assert value(spark, identifiers.normalized_pmid(F.col("c")), "c string", raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("978-88-15-12345-X", "isbn:978881512345x"),
        ("888809556X; 9788815000000", "isbn:888809556x"),
        ("ISBN 978-88-15-12345-6", "isbn:isbn9788815123456"),
        ("ISBN-13: 9788815123456", "isbn:isbn13:9788815123456"),
        ("12345", None),
        (None, None),
    ],
)
def test_isbn(spark, raw, expected):
    assert value(spark, identifiers.normalized_isbn(F.col("c")), "c string", raw) == expected


@pytest.mark.parametrize(
    "ids, omid, pid",
    [
        ("doi:10.1/a omid:br/06 pmid:12", "omid:br/06", "doi:10.1/a"),
        ("omid:br/06", "omid:br/06", None),
        ("isbn:9788800000000 pmid:12 omid:br/1", "omid:br/1", "pmid:12"),
        ("isbn:9788800000000", None, "isbn:9788800000000"),
        ('doi:10.1/A" omid:br/2', "omid:br/2", "doi:10.1/A"),
        (None, None, None),
    ],
)
def test_id_list(spark, ids, omid, pid):
    assert value(spark, records.omid(F.col("c")), "c string", ids) == omid
    assert value(spark, records.canonical_id(F.col("c")), "c string", ids) == pid


@pytest.mark.parametrize(
    "pid, scheme, key, rank",
    [
        ("doi:10.1/a", "doi", "doi:", 0),
        ("pmid:12", "pmid", "pmid", 1),
        ("isbn:88", "isbn", "isbn", 2),
        ("other", None, "othe", 3),
    ],
)
def test_scheme(spark, pid, scheme, key, rank):
    assert value(spark, identifiers.scheme(F.col("c")), "c string", pid) == scheme
    assert value(spark, identifiers.scheme_key(F.col("c")), "c string", pid) == key
    assert value(spark, identifiers.scheme_rank(F.col("c")), "c string", pid) == rank


def test_type_priority(spark):
    cases = [
        ("doi:x", 35), ("doi:x", 50), ("doi:x", 41), ("doi:x", 57), ("doi:x", 99), ("doi:x", None),
        ("pmid:x", 35), ("pmid:x", 50), ("isbn:x", 49), ("isbn:x", 35), ("isbn:x", 50),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, id string, code int")
    found = df.select(
        "n", identifiers.type_priority(F.col("id"), F.col("code")).alias("p")
    ).orderBy("n")
    p = [r["p"] for r in found.collect()]
    assert p[:4] == sorted(p[:4]) and len(set(p[:4])) == 4
    assert p[4] == p[5] and p[4] > p[3]
    assert p[6] < p[7] and p[8] < p[9] < p[10]


@pytest.mark.parametrize(
    "title, cleaned, n_words",
    [
        ('A "quoted"\r\nline', "A 'quoted' line", 3),
        ("two words", "two words", 2),
        ("  spaced   out words ", "  spaced   out words ", 3),
        ("a b c", "a b c", 3),
        ("", "", 0),
    ],
)
def test_title(spark, title, cleaned, n_words):
    assert value(spark, records.clean_title(F.col("c")), "c string", title) == cleaned
    assert value(spark, records.word_count(records.clean_title(F.col("c"))), "c string", title) == n_words


def test_author_line(spark):
    schema = "a array<struct<given:string,family:string>>"
    authors = [("A", "B"), (None, "D"), ("E", None)]
    assert value(spark, records.author_line(F.col("a")), schema, authors) == "A B,  D"
    assert value(spark, records.author_line(F.col("a")), schema, []) == ""


def test_years(spark):
    for text, year in [("2020-01", "2020"), ("c. 1999", "1999"), ("12", None), (None, None)]:
        assert value(spark, records.year_text(F.col("c")), "c string", text) == year
    for number in (1, 2020, 9999, None):
        assert value(spark, records.year_of_issue(F.col("c")), "c int", number) == number


def test_labels_and_addresses(spark):
    assert value(spark, records.named_blank(F.col("c")), "c string", "") == "no type"
    assert value(spark, records.named_blank(F.col("c")), "c string", None) is None
    address = "https://w3id.org/oc/meta/br/061"
    assert value(spark, records.entity_omid(F.col("c")), "c string", address) == "omid:br/061"
    text = records.bibliographic_text(F.col("t"), F.col("a"))
    assert value(spark, text, "t string, a string", "T", "A, B") == "T, A, B"
    assert value(spark, text, "t string, a string", "T", None) == "T"


def test_words(spark):
    found = value(spark, records.words(F.col("c")), "c string", "Èté, été! The the 42.")
    assert found == sorted({"èté", "été", "the", "42"}, key=lambda w: w.encode())
    assert value(spark, records.words(F.col("c")), "c string", " ... ") == []

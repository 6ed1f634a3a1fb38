"""The five questions: coverage, types, citations, external and internal citations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspan import fixed_values as fixed
from bibspan.functions import records
from bibspan.operators import groups, membership
from bibspan.operators.sizing import written


def question_1(in_meta: DataFrame) -> DataFrame:
    """Matched items, all and by scheme, from one pass."""
    pid = F.col("id")
    return in_meta.agg(
        F.count(F.lit(1)).alias("len"),
        F.count_if(pid.contains("doi")).alias("doi"),
        F.count_if(pid.contains("pmid")).alias("pmid"),
        F.count_if(pid.contains("isbn")).alias("isbn"),
    )


def question_2(in_meta: DataFrame) -> DataFrame:
    """Matched items per item type, most frequent first."""
    return groups.ranked_counts(in_meta, "iris_type")


def question_2_meta_types(in_meta: DataFrame) -> DataFrame:
    """Matched items per global type, a blank type named."""
    counts = groups.count_by(in_meta, "meta_type")
    return counts.select(records.named_blank(F.col("meta_type")).alias("meta_type"), "len").orderBy(
        F.col("len").desc(), F.col("meta_type").asc_nulls_last()
    )


def question_3(citations: DataFrame) -> DataFrame:
    return citations.agg(F.count(F.lit(1)).alias("len"))


def _outside(end: str) -> Column:
    """The end is known and not a member; an unknown end counts on neither side."""
    return F.col(end).isNotNull() & ~F.col(f"{end}_in")


def _citation_counts(citations: DataFrame, in_meta: DataFrame | None, omids: DataFrame | None) -> DataFrame:
    if omids is None:
        omids = written(membership.members(in_meta), "members")
    return membership.end_flags(citations, omids).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_outside("citing")).alias("citing"),
        F.count_if(_outside("cited")).alias("cited"),
        F.count_if(F.col("citing_in") & F.col("cited_in")).alias("both"),
    )


def citation_questions(
    citations: DataFrame, in_meta: DataFrame | None = None, omids: DataFrame | None = None
) -> DataFrame:
    """Questions 3, 4 and 5 together: one scan of the citations, one row of counts.

    `citations` may be the filtered dataset or the whole dump; rows without a member
    end do not count.  With `omids`, the written dataset of members, one row each, the
    members are not taken from the matched items again; so it is with the other questions.
    """
    return _citation_counts(citations, in_meta, omids)


def question_4(
    citations: DataFrame, in_meta: DataFrame | None = None, omids: DataFrame | None = None
) -> DataFrame:
    """Citations whose citing, or cited, end is no matched item."""
    return _citation_counts(citations, in_meta, omids).select("citing", "cited")


def question_5(
    citations: DataFrame, in_meta: DataFrame | None = None, omids: DataFrame | None = None
) -> DataFrame:
    """Citations with both ends among the matched items."""
    return _citation_counts(citations, in_meta, omids).select(F.col("both").alias("len"))


def citation_shares(
    citations: DataFrame, in_meta: DataFrame | None = None, omids: DataFrame | None = None
) -> DataFrame:
    counts = _citation_counts(citations, in_meta, omids)
    total = F.col("total")
    return counts.select(
        "total",
        records.percent(F.col("citing"), total).alias("pct_citing_outside"),
        records.percent(F.col("cited"), total).alias("pct_cited_outside"),
        records.percent(F.col("both"), total).alias("pct_both"),
    )


def named_types(counts: DataFrame) -> DataFrame:
    """Type counts with empty and missing types named, as in the charts."""
    label = F.when(F.coalesce("iris_type", F.lit("")) == "", fixed.UNSPECIFIED_LABEL).otherwise(
        F.col("iris_type")
    )
    return counts.select(label.alias("iris_type"), "len")

"""First-row-per-key operators.

Every one is a row_number window cut to rank 1.  Spark plans a window group limit
before the shuffle, so each map task sends at most one row per key: a key that holds
a third of all rows costs its reducer one row per task, not the whole group.
Every order ends in all columns of the row, so only rows that are equal altogether tie,
and results do not depend on the order of files.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspan.functions import identifiers, records


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [F.col(c).asc_nulls_last() for c in sorted(set(df.columns) - set(keys))]
    window = Window.partitionBy(*keys).orderBy(*order, *rest)
    ranked = df.withColumn("_rank", F.row_number().over(window))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def one_pid_per_item(pids: DataFrame) -> DataFrame:
    pid = F.col("id")
    order = [identifiers.scheme_rank(pid).asc(), pid.asc(), F.col("iris_type").asc_nulls_last()]
    return first_by_key(pids, ["iris_id"], order)


def one_item_per_pid(pids: DataFrame) -> DataFrame:
    """Keep, of the items sharing an id, the one whose type has the best priority."""
    priority = identifiers.type_priority(F.col("id"), F.col("iris_type"))
    return first_by_key(pids, ["id"], [priority.asc(), F.col("iris_id").asc()])


def unique_keep_first(pids: DataFrame) -> DataFrame:
    """First item of every id, whatever its type."""
    return first_by_key(pids, ["id"], [F.col("iris_id").asc()])


def one_record_per_pid(matches: DataFrame) -> DataFrame:
    """Keep, of the records sharing an id, the one whose type fits the item's type best."""
    preference = records.type_preference(F.col("type"), F.col("iris_type"))
    return first_by_key(matches, ["id"], [preference.desc_nulls_last(), F.col("omid").asc()])


def one_record_per_pid_strict(matches: DataFrame) -> DataFrame:
    """Stricter choice among records that share an id but differ in type.

    Blank types go first; where types still differ only preferred type pairs stay,
    and an id with none of them is dropped altogether.  One row per id and type is
    enough for all of this, so the windows below hold a handful of rows per id.
    """
    by_id = Window.partitionBy("id")
    per_type = first_by_key(matches, ["id", "type"], [F.col("omid").asc()])
    filled = (
        per_type.withColumn("_types", F.count(F.lit(1)).over(by_id))
        .where((F.col("_types") == 1) | F.col("type").isNull() | (F.col("type") != ""))
        .withColumn("_types", F.count(F.lit(1)).over(by_id))
    )
    preferred = records.type_preference(F.col("type"), F.col("iris_type")).isNotNull()
    fitting = filled.where((F.col("_types") == 1) | preferred).drop("_types")
    one_per_pid = first_by_key(fitting, ["id"], [F.col("omid").asc()])
    return first_by_key(one_per_pid, ["iris_id"], [F.col("id").asc()])


def clean_no_id(no_id: DataFrame) -> DataFrame:
    """Titled items, authors in lower case, one per title and author text."""
    return first_by_key(titled_no_id(no_id), ["TITLE", "DES_ALLPEOPLE"], [F.col("ITEM_ID").asc()])


def titled_no_id(no_id: DataFrame) -> DataFrame:
    return no_id.na.drop(subset=["TITLE"]).withColumn("DES_ALLPEOPLE", F.lower("DES_ALLPEOPLE"))

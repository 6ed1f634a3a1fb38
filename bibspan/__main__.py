"""Command line: `build` writes the datasets, `update` adds new shards, `match` looks for works, `answer` answers the questions."""

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspan.plans import datasets, questions, reconciliation
from bibspan.session import configured
from bibspan.sources import tables
from bibspan.sources.sinks import current_version


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="bibspan", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="build datasets")
    build.add_argument("--repository", required=True, help="folder or ZIP of repository tables")
    build.add_argument("--meta", required=True, help="metadata dump (ZIP, TAR or Parquet)")
    build.add_argument("--index", help="folder of citation archives, or a ZIP of them")
    build.add_argument("--publications", help="Parquet table of works to match items without identifier with")
    build.add_argument("--out", required=True, help="output folder")
    build.add_argument("--steps", nargs="+", choices=datasets.STEPS + datasets.MORE_STEPS, default=list(datasets.STEPS))
    update = commands.add_parser("update", help="bring datasets up to date with new shards")
    update.add_argument("--data", required=True, help="output folder of build")
    update.add_argument("--meta", required=True, help="new shards of the metadata")
    update.add_argument("--index", help="new shards of the citations")
    update.add_argument("--old-index", help="the citations so far, read only for new members")
    match = commands.add_parser("match", help="match items without identifier, going on after the last run")
    match.add_argument("--data", required=True, help="output folder of build, with clean_no_id")
    match.add_argument("--publications", required=True)
    answer = commands.add_parser("answer", help="answer the questions")
    answer.add_argument("--data", required=True, help="output folder of build")
    answer.add_argument("--question", type=int, choices=range(1, 6))
    return parser.parse_args()


def main() -> None:
    args = arguments()
    spark = configured(SparkSession.builder.appName("bibspan").getOrCreate())
    if args.command == "build":
        if "citations" in args.steps and args.index is None:
            raise SystemExit("the citations need --index")
        if {"match_results", "reconciled"} & set(args.steps) and args.publications is None:
            raise SystemExit("matching needs --publications")
        inputs = datasets.open_inputs(spark, args.repository, args.meta, args.index, args.publications)
        datasets.build(spark, inputs, args.out, tuple(args.steps))
        return
    if args.command == "update":
        index = tables.read_index(spark, args.index) if args.index else None
        old = tables.read_index(spark, args.old_index) if args.old_index else None
        datasets.update(spark, args.data, tables.read_meta(spark, args.meta), index, old)
        return

    def table(name):
        return tables.read_parquet(spark, f"{args.data}/{name}")

    if args.command == "match":
        items = f"{args.data}/clean_no_id"
        query = reconciliation.match_as_they_come(
            spark, current_version(items), table("clean_no_id").schema, tables.read_parquet(spark, args.publications),
            f"{args.data}/match_results_so_far", f"{args.data}/match_checkpoint",
        )
        query.awaitTermination()
        return

    answers = {
        1: lambda: questions.question_1(table("in_meta")),
        2: lambda: questions.question_2(table("in_meta")),
        3: lambda: questions.question_3(table("citations")),
        4: lambda: questions.question_4(table("citations"), omids=table("omids")),
        5: lambda: questions.question_5(table("citations"), omids=table("omids")),
    }
    if args.question:
        show(args.question, answers[args.question]())
        return
    show(1, answers[1]())
    show(2, answers[2]())
    # The last three come from one scan of the citations.
    counts = questions.citation_questions(table("citations"), omids=table("omids")).collect()
    counts = spark.createDataFrame(counts, "total long, citing long, cited long, both long")
    show(3, counts.select(F.col("total").alias("len")))
    show(4, counts.select("citing", "cited"))
    show(5, counts.select(F.col("both").alias("len")))


def show(number: int, answer: DataFrame) -> None:
    print(f"Question {number}")
    answer.show(truncate=False)


if __name__ == "__main__":
    main()

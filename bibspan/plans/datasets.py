"""The derived datasets of a repository, built in order and written once."""

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from bibspan.operators import dedup, items as item_ops, linkage, lookup, matching, membership
from bibspan.operators.sizing import written
from bibspan.plans import reconciliation, updates
from bibspan.session import configured
from bibspan.sources import tables

STEPS = ("in_meta", "not_in_meta", "no_id", "title_matches", "citations")
# Made on request only: they need more inputs or are another form of one of the above.
MORE_STEPS = ("clean_no_id", "title_classes", "match_results", "reconciled")


@dataclass
class Datasets:
    """Inputs, and every dataset made from them, each computed and written at first use.

    Written tables serve three ends: later datasets start from them instead of
    repeating the work, Spark knows their exact size when it chooses a join, and a lost
    executor costs no more than the stage it was running.  `folder` is the output
    folder, in which each table is published as a version; without one, tables go to the shared folder of the session.
    With `read_once` the joined items and the parsed metadata are written as well, for a build in which several
    datasets start from them: then each input is read once.
    """

    spark: SparkSession
    inputs: dict[str, DataFrame]
    folder: str | None = None
    read_once: bool = False
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def _once(self, name: str, plan) -> DataFrame:
        if name not in self._made:
            self._made[name] = written(plan(), name, self.folder)
        return self._made[name]

    def _shared(self, name: str, plan) -> DataFrame:
        """A table between inputs and datasets, in the shared folder of the session."""
        if not self.read_once:
            return plan()
        if name not in self._made:
            self._made[name] = written(plan(), name)
        return self._made[name]

    @property
    def described_items(self) -> DataFrame:
        """Identifiers with all that the master table knows of their item."""
        return self._shared("described_items", lambda: self.inputs["identifier"].join(self.inputs["master"], "ITEM_ID"))

    @property
    def items(self) -> DataFrame:
        if self.read_once:
            return self.described_items.drop("DATE_ISSUED_YEAR", "TITLE")
        return item_ops.joined_items(self.inputs["identifier"], self.inputs["master"])

    @property
    def labels(self) -> DataFrame:
        return self._once("type_labels", lambda: lookup.type_labels(self.items))

    @property
    def pids(self) -> DataFrame:
        """One identifier per item and one item per identifier."""

        def plan():
            best = item_ops.preferred_pids(self.items)
            return dedup.one_item_per_pid(dedup.one_pid_per_item(best))

        return self._once("pids", plan)

    @property
    def parsed_meta(self) -> DataFrame:
        return self._shared("parsed_meta", lambda: matching.parse_meta(self.inputs["meta"]))

    @property
    def in_meta(self) -> DataFrame:
        def plan():
            if self.read_once:
                return matching.in_parsed_meta(self.parsed_meta, self.pids, self.labels)
            return matching.in_meta(self.inputs["meta"], self.pids, self.labels)

        return self._once("in_meta", plan)

    @property
    def omids(self) -> DataFrame:
        """Members of the citation questions, one row each: written once, and passed on to all that ask."""
        return self._once("omids", lambda: membership.members(self.in_meta))

    @property
    def not_in_meta(self) -> DataFrame:
        return self._once("not_in_meta", lambda: matching.not_in_meta(self.pids, self.in_meta))

    @property
    def no_id(self) -> DataFrame:
        def plan():
            details = [self.inputs[n] for n in ("description", "publisher", "language")]
            return item_ops.no_id_dataset(self.described_items, *details)

        return self._once("no_id", plan)

    @property
    def clean_no_id(self) -> DataFrame:
        return self._once("clean_no_id", lambda: dedup.clean_no_id(self.no_id))

    @property
    def untraced_titles(self) -> DataFrame:
        if "untraced_titles" not in self._made:
            untraced = item_ops.without_pid(self.described_items).select("ITEM_ID", "TITLE")
            self._made["untraced_titles"] = written(untraced, "untraced_titles")
        return self._made["untraced_titles"]

    @property
    def title_matches(self) -> DataFrame:
        """One row per item and record of equal title: published with a folder, else made as they are read."""
        if self.folder:
            return self._once("title_matches", lambda: self.classes_of_titles.expanded())
        if "title_matches" not in self._made:
            self._made["title_matches"] = self.classes_of_titles.expanded()
        return self._made["title_matches"]

    @cached_property
    def classes_of_titles(self) -> linkage.TitleClasses:
        """The title matches as written classes, items and records, whose size is that of the inputs."""
        return linkage.title_classes(self.untraced_titles, self.parsed_meta)

    @property
    def title_classes(self) -> DataFrame:
        """Titles on both sides with the numbers of their items and records; the pairs are not made."""
        return self._once("title_classes", lambda: self.classes_of_titles.classes)

    @property
    def match_results(self) -> DataFrame:
        """Best matches, by title and authors, of the items without identifier."""
        return self._once("match_results", lambda: reconciliation.best_matches(self.clean_no_id, self.inputs["publications"]))

    @property
    def reconciled(self) -> DataFrame:
        return self._once("reconciled", lambda: reconciliation.reconciled(self.match_results, self.parsed_meta))

    @property
    def citations(self) -> DataFrame:
        return self._once(
            "citations", lambda: membership.filter_citations(self.inputs["index"], self.omids)
        )


def open_inputs(
    spark: SparkSession, repository: str, meta: str, index: str | None = None, publications: str | None = None
) -> dict:
    """Readers for a repository folder or ZIP, a metadata dump, a citation dump and a table of publications."""
    inputs = {
        name: tables.repository_table(spark, repository, name)
        for name in ("master", "identifier", "description", "publisher", "language")
    }
    inputs["meta"] = tables.read_meta(spark, meta)
    if index is not None:
        inputs["index"] = tables.read_index(spark, index)
    if publications is not None:
        inputs["publications"] = tables.read_parquet(spark, publications)
    return inputs


def build(
    spark: SparkSession, inputs: dict[str, DataFrame], folder: str, steps: tuple = STEPS
) -> dict[str, DataFrame]:
    """Build the chosen datasets, in their fixed order, below one folder.

    Every table has a folder of its own in which a new version replaces the last one, so a second run gives the
    same result as the first.
    """
    unknown = set(steps) - set(STEPS + MORE_STEPS)
    if unknown:
        raise ValueError(f"unknown datasets: {sorted(unknown)}")
    data = Datasets(configured(spark), inputs, folder, read_once=len(steps) > 1)
    return {step: getattr(data, step) for step in STEPS + MORE_STEPS if step in steps}


def update(
    spark: SparkSession, folder: str, meta: DataFrame, index: DataFrame | None = None, old_index: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Bring the datasets of a build up to date with new shards of the metadata and the citations.

    The identifiers, labels and matches are those of the build; of the old dumps only the citations are read, and those only
    where a new member may have some.
    """
    spark = configured(spark)

    def table(name: str) -> DataFrame:
        return tables.read_parquet(spark, f"{folder}/{name}")

    pids, before = table("pids"), table("omids")
    in_meta = written(updates.updated_in_meta(table("in_meta"), meta, pids, table("type_labels")), "in_meta", folder)
    made = {"in_meta": in_meta, "not_in_meta": written(matching.not_in_meta(pids, in_meta), "not_in_meta", folder)}
    made["omids"] = written(membership.members(in_meta), "omids", folder)
    if index is not None:
        changed = updates.updated_citations(table("citations"), index, before, made["omids"], old_index)
        made["citations"] = written(changed, "citations", folder)
    return made

"""The tables of one collection, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidemark.operators import curation, duplicates
from tidemark.operators.edits import highest_id
from tidemark.params import Settings
from tidemark.session import cut
from tidemark.sources import tables


@dataclass(frozen=True)
class Library:
    """``tables`` holds DataFrames, or functions that make one when it is first asked for."""

    spark: SparkSession
    tables: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    settings: Settings = Settings()
    # shared by the libraries made from this one
    known_hidden: list[tuple[DataFrame, DataFrame, DataFrame]] = field(default_factory=list, repr=False, compare=False)

    def __getitem__(self, name: str) -> DataFrame:
        found = self.tables.get(name)
        if found is None:
            return tables.empty(self.spark, name)
        if not isinstance(found, DataFrame):
            found = self.tables[name] = found()
        return found

    def having(self, **changed: DataFrame) -> "Library":
        return replace(self, tables={**self.tables, **changed})

    @classmethod
    def load(cls, spark: SparkSession, base: str, settings: Settings = Settings()) -> "Library":
        """All tables below ``base``; each is read lazily and pruned to what a query needs."""
        return cls(spark, {name: partial(tables.load, spark, base, name) for name in tables.SCHEMAS}, settings)

    def store(self, base: str, *names: str) -> None:
        for name in names:
            tables.store(self[name], base, name)

    # ---------- ids ----------

    def top_id(self, name: str) -> int:
        """Highest id that a table has or ever had."""
        mark = self["id_marks"].where(F.col("name") == name).agg(F.max("top").alias("top")).first()["top"]
        return max(mark or 0, highest_id(self[name]))

    def marked(self, name: str, top: int) -> "Library":
        row = self.spark.createDataFrame([(name, top)], tables.SCHEMAS["id_marks"])
        kept = self["id_marks"].where(F.col("name") != name)
        return self.having(id_marks=kept.unionByName(row))

    # ---------- shared intermediates ----------

    def hidden(self) -> DataFrame:
        """Worked out once for the same groups: far narrower than they are, and read by several branches of a query."""
        groups, members = self["dup_groups"], self["dup_members"]
        for known_groups, known_members, hidden in self.known_hidden:
            if known_groups is groups and known_members is members:
                return hidden
        hidden = cut(duplicates.hidden_copies(groups, members))
        self.known_hidden.append((groups, members, hidden))
        return hidden

    def curation_items(self) -> DataFrame:
        return curation.curation_items(
            self["media"], self["quality"], self["embeddings"], self["faces"], self["persons"], self.hidden()
        )

    def live_members(self) -> DataFrame:
        """(event_id, id, taken_at) of live items."""
        live = self["media"].where("not missing").select("id", "taken_at")
        members = self["event_media"].select("event_id", "media_id", "assigned_by").withColumnRenamed("media_id", "id")
        return members.join(live, "id")

"""The care tables as one bundle (SRC-1)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tendril.operators.dims import Dim
from tendril.sources import schemas


@dataclass
class CareTables:
    plant_types: DataFrame
    plants: DataFrame
    event_types: DataFrame
    events: DataFrame
    reminders: DataFrame
    measurements: DataFrame
    plant_images: DataFrame
    plant_changes: DataFrame | None = None
    plants_history: DataFrame | None = None
    # Size checks of the two type catalogs, done once per bundle.
    _dims: dict = field(default_factory=dict, repr=False)

    def dim(self, name: str) -> DataFrame:
        """plant_types / event_types ready for a join (broadcast only if checked small)."""
        if name not in self._dims:
            self._dims[name] = Dim(getattr(self, name))
        return self._dims[name].for_join()

    @property
    def spark(self) -> SparkSession:
        return self.plants.sparkSession


def load_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> CareTables:
    """Read the eight tables from ``{path}/{table}`` with their declared schema
    (partition folders of the storage layout add their column, e.g. ``_month``)."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(schemas.TABLES[name]).format(fmt).load(f"{path}/{name}")

    def optional(name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return read(name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None  # table folder not written (no history yet)

    return CareTables(
        plant_types=read("plant_types"),
        plants=read("plants"),
        event_types=read("event_types"),
        events=read("events"),
        reminders=read("reminders"),
        measurements=read("measurements"),
        plant_images=read("plant_images"),
        plants_history=optional("plants_history"),
    )

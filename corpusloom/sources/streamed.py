"""Rows of a remote iterator (a dataset hub, say) as a Spark source that stops early.

    spark.dataSource.register(IteratorSource)
    spark.read.format("rows").schema("text string").option("factory", "package.module:function").option("most", 50000).load()

The function is imported on the executor that reads; it gets all other options
as strings and gives mappings.  One task reads, since an iterator has one end;
of more than ``most`` rows no further one is asked for.
"""

from __future__ import annotations

from importlib import import_module
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class IteratorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rows"

    def schema(self) -> StructType:
        raise ValueError("the format 'rows' needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema.fieldNames())


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        if ":" not in options.get("factory", ""):
            raise ValueError("option factory: package.module:function")
        self.module, self.function = options.pop("factory").split(":", 1)
        most = options.pop("most", None)
        self.most = None if most is None else int(most)
        self.options, self.names = options, names

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        rows = getattr(import_module(self.module), self.function)(**self.options)
        for row in islice(rows, self.most):
            yield tuple(row.get(n) for n in self.names)

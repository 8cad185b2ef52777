"""The property graph: two DataFrames, nodes and edges, with JSON properties."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "array<string>": ArrayType(StringType())}


def _schema(**columns: str) -> StructType:
    return StructType([StructField(name, _KINDS[kind]) for name, kind in columns.items()])


def schema_of(ddl: str) -> StructType:
    """The schema of columns `name type, ...`, without a session."""
    return _schema(**dict(column.split() for column in ddl.split(", ")))


NODE_SCHEMA = _schema(id="long", project="string", label="string", name="string", qualified_name="string", file_path="string", start_line="int", end_line="int", properties="string")
EDGE_SCHEMA = _schema(id="long", project="string", source_id="long", target_id="long", type="string", properties="string")
PROJECT_SCHEMA = _schema(name="string", indexed_at="string", root_path="string")
FILE_HASH_SCHEMA = _schema(project="string", rel_path="string", sha256="string", mtime_ns="long", size="long")
SUMMARY_SCHEMA = _schema(project="string", summary="string", created_at="string", updated_at="string")

#: Names of node and edge attributes that are columns; all others are properties.
NODE_COLUMNS = tuple(f.name for f in NODE_SCHEMA if f.name != "properties")
EDGE_COLUMNS = ("id", "source_id", "target_id", "type")


def json_property(properties: Column, name: str) -> Column:
    """A property as text; null where it is missing."""
    return F.get_json_object(properties, "$['" + name.replace("'", "\\'") + "']")


def json_number(properties: Column, name: str) -> Column:
    """A property as a double; null where it is missing or no number."""
    return json_property(properties, name).try_cast("double")


@dataclass(frozen=True)
class Graph:
    """nodes and edges; a column `project` tells graphs in one table apart. In a closed
    graph every edge's ends are nodes, so a query may take an end's id from the edge."""

    nodes: DataFrame
    edges: DataFrame
    closed: bool = False

    def of(self, project: str) -> Graph:
        return Graph(self.nodes.where(F.col("project") == project), self.edges.where(F.col("project") == project), self.closed)

    def labelled(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def typed(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types)) if types else self.edges

    @classmethod
    def read(cls, spark, path: str) -> Graph:
        """Parquet tables nodes and edges under `path`, partitioned by project."""
        return cls(spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{path}/edges"))

    def write(self, path: str) -> None:
        """Sorted within files by what scans filter on, so that row groups are skipped."""
        self.nodes.repartition("project", "label").sortWithinPartitions("label", "qualified_name").write.mode("overwrite").partitionBy("project").parquet(f"{path}/nodes")
        self.edges.repartition("project", "type").sortWithinPartitions("type", "source_id").write.mode("overwrite").partitionBy("project").parquet(f"{path}/edges")

"""Written tables: intermediate ones in the shared folder, and the memory graph's own, one folder of versions each."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from . import schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read again: lineage and plan end there."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Tables of a memory graph as Parquet: {path}/{table}/v000001, v000002 and so on.

    A write is a new version, which counts once Spark's commit marker is there, so readers never see half of one and a crashed write leaves the
    last version in place. The version before is kept for those who still read it."""

    TABLES = {"nodes": schema.NODES, "edges": schema.EDGES, "chunks": schema.CHUNKS, "vectors": schema.VECTORS, "access_log": schema.ACCESS_LOG, "projects": schema.PROJECTS, "embed_config": schema.EMBED_CONFIG}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self, table: str) -> list[str]:
        if not self._fs.exists(self._at(table)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(table)))
        return [n for n in names if n.startswith("v") and self._fs.exists(self._at(table, n, "_SUCCESS"))]

    def read(self, table: str) -> DataFrame:
        found = self.versions(table)
        if not found:
            return self.spark.createDataFrame([], self.TABLES[table])
        return self.spark.read.schema(self.TABLES[table]).parquet(f"{self.path}/{table}/{found[-1]}")

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """The next version of a table; rows may be made from the last one. Columns that rows lack are null."""
        found = self.versions(table)
        n = 1 + int(found[-1][1:]) if found else 1
        fields = self.spark.createDataFrame([], self.TABLES[table]).schema.fields
        have = set(rows.columns)
        from pyspark.sql import functions as F

        shaped = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        self._fs.delete(self._at(table, f"v{n:06d}"), True)  # what a crashed write has left
        shaped.write.parquet(f"{self.path}/{table}/v{n:06d}")
        for old in found[:-1]:
            self._fs.delete(self._at(table, old), True)
        return self.read(table)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        return self.write(table, self.read(table).unionByName(rows, allowMissingColumns=True))

    def set_marker(self, name: str) -> None:
        """A job's marker: found at the next start, it tells that the job did not end."""
        self._fs.mkdirs(self._at("markers"))
        self._fs.create(self._at("markers", name), True).close()

    def clear_marker(self, name: str) -> None:
        self._fs.delete(self._at("markers", name), False)

    def has_marker(self, name: str) -> bool:
        return self._fs.exists(self._at("markers", name))

    def backup(self, to: str) -> list[str]:
        """Copy the last version of each table whose version the backup lacks; the names of those copied."""
        there, copied = Store(self.spark, to), []
        for table in self.TABLES:
            last = self.versions(table)[-1:]
            if last and there.versions(table)[-1:] != last:
                self.spark.read.parquet(f"{self.path}/{table}/{last[0]}").write.mode("overwrite").parquet(f"{there.path}/{table}/{last[0]}")
                copied.append(table)
        return copied

"""Results that are computed once and read again, by any session that shares the store.

A result's name is the digest of its canonical plan (so it doesn't matter how columns are numbered or which session asks), its schema, the
parameters, and a snapshot of its source files (path, length, time of change): another filter, another parameter or a changed file is another
result. It is written beside its place and published by a rename, so a reader never meets half a result, and two
writers at once each publish a whole one. A stored result is read for ``ttl`` seconds (an hour); ``clear`` empties the store by hand.

Plans whose content the name can't tell are refused: sources that are no files (rows in memory, checkpoints), Python functions, and
expressions that are not deterministic.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from salesspark.session import ensure_checkpoint_dir
from salesspark.sources.stored import Store, attempt_name

#: Fixed value: the lifetime of a result in seconds.
TTL = 3600


def plan_name(df: DataFrame, params: dict | None = None) -> str:
    """The digest that names a result."""
    spark, plan = df.sparkSession, df._jdf.queryExecution().analyzed()
    python = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.trees.TreePattern.PYTHON_UDF()
    if not plan.deterministic() or plan.containsPattern(python):
        raise ValueError("results of Python functions or non-deterministic expressions are not reused")
    leaves = plan.collectLeaves()
    relations = []
    for leaf in (leaves.apply(i) for i in range(leaves.size())):
        if leaf.getClass().getSimpleName() not in ("LogicalRelation", "OneRowRelation"):
            raise ValueError(f"results over {leaf.getClass().getSimpleName()} are not reused: its rows have no name")
        relations.append(leaf.relation().location().rootPaths().toString() if leaf.getClass().getSimpleName() == "LogicalRelation" else "")
    canonical = re.sub(r'"jvmId":"[^"]*"', "", plan.canonicalized().toJSON())
    said = [canonical, relations, df.schema.json(), sorted((k, repr(v)) for k, v in (params or {}).items()),
            Store(spark).snapshot(df.inputFiles())]
    return hashlib.sha256(json.dumps(said).encode()).hexdigest()


@dataclass
class ResultStore:
    """Results below ``root`` (by default a folder in the shared checkpoint folder)."""

    spark: SparkSession
    root: str | None = None
    ttl: float = TTL
    clock: Callable[[], float] = time.time
    hits: int = field(default=0, init=False)
    misses: int = field(default=0, init=False)

    def __post_init__(self):
        self.root = self.root or f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/results"
        self.store = Store(self.spark)

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """(milliseconds, URI) of the published versions of a result, oldest first."""
        found = []
        for uri, _, _ in self.store.children(f"{self.root}/{name}"):
            m = re.fullmatch(r"v-(\d+)-[0-9a-f]+", uri.rstrip("/").rsplit("/", 1)[1])
            if m:
                found.append((int(m.group(1)), uri))
        return sorted(found)

    def reuse(self, df: DataFrame, params: dict | None = None) -> DataFrame:
        """The stored result of ``df``, computed and stored first if there is none young enough."""
        name, now = plan_name(df, params), self.clock()
        young = [uri for ms, uri in self._versions(name) if now - ms / 1000 < self.ttl]
        if young:
            self.hits += 1
            return self.spark.read.schema(df.schema).parquet(young[-1])
        self.misses += 1
        place = f"{self.root}/{name}/v-{int(now * 1000):015d}-{uuid.uuid4().hex}"
        tried = attempt_name(f"{self.root}/{name}")
        df.write.parquet(tried)
        self.store.rename(tried, place)
        for ms, uri in self._versions(name):  # old versions go when no reader can have started on them lately
            if now - ms / 1000 >= 2 * self.ttl:
                self.store.delete(uri)
        return self.spark.read.schema(df.schema).parquet(place)

    def query(self, sql: str, params: dict | None = None) -> DataFrame:
        """S3 and S5 together: parameterised SQL, answered from the store when it can be."""
        return self.reuse(self.spark.sql(sql, args=params or {}), params)

    def clear(self) -> None:
        """Empty the store."""
        self.store.delete(self.root)

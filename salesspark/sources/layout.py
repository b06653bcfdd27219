"""A stored layout of lines and orders in which the view's largest join needs no shuffle.

``lineitem`` and ``orders`` are written once to the shared store, bucketed on the order key by the same hash into the same number of
files and sorted by it. Each pair of buckets joins in one task, and whatever is grouped by order needs no exchange either. A bucket's
size is chosen once, from the size of the sources. The layout's folder is named by a snapshot of the source files and the number of buckets: when a
source changes, the next call writes another layout. It is published by a rename when it is whole, and two sessions that write at once use
the one that sorts first.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from salesspark.session import ensure_checkpoint_dir
from salesspark.sources.stored import Store, attempt_name
from salesspark.sources.tables import read_table

#: Bytes of source files that one bucket stands for.
BUCKET_BYTES = 128 << 20
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def _published(store: Store, folder: str) -> str | None:
    versions = [uri for uri, _, _ in store.children(folder) if uri.rstrip("/").rsplit("/", 1)[1].startswith("v-")]
    return min(versions, default=None)


def stored_layout(spark: SparkSession, sf_dir: str, root: str | None = None, buckets: int | None = None) -> dict[str, DataFrame]:
    """``lineitem`` and ``orders`` of ``sf_dir`` from the layout below ``root``, which is written first if there is none of these files."""
    store, root = Store(spark), root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/layout"
    sources = {name: read_table(spark, sf_dir, name) for name in KEYS}
    files = store.snapshot([f for df in sources.values() for f in df.inputFiles()])
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or max(wide, sum(length for _, length, _ in files) // BUCKET_BYTES)
    name = hashlib.sha256(json.dumps([files, n]).encode()).hexdigest()[:24]
    place = _published(store, f"{root}/{name}")
    if place is None:
        tried, mark = attempt_name(f"{root}/{name}"), uuid.uuid4().hex
        for table, key in KEYS.items():  # dealt by the buckets' own hash first, so that each bucket is one sorted file
            spark.sql(f"DROP TABLE IF EXISTS layout_{mark}_{table}")
            sources[table].repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{tried}/{table}") \
                .format("parquet").saveAsTable(f"layout_{mark}_{table}")
            spark.sql(f"DROP TABLE layout_{mark}_{table}")  # the files stay
        store.rename(tried, f"{root}/{name}/v-{mark}")
        place = _published(store, f"{root}/{name}")
    out = {}
    for table, key in KEYS.items():
        known = f"layout_{hashlib.sha256(place.encode()).hexdigest()[:24]}_{table}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sources[table].schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
                  f"INTO {n} BUCKETS LOCATION '{place}/{table}'")
        out[table] = spark.table(known)
    return out

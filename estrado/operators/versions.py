"""Tables with versions: several tables change together, or not at all.

A store is a folder. Rows lie in data/<table>/<change>/bucket=<n>, dealt by a hash of their key; a change writes the buckets that it touches anew, into a folder of its own, and leaves all others where they
are. A version is one small file in versions/ that says which folder each bucket of each table is in; it is written aside and moved to the next number, which the file system allows once. So
readers see the tables of one version, rows and flags alike, and a writer that dies before its version leaves folders that no version names. Of two writers that began at
one version the second is refused and tries again from the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table: what a version's file lists, and the parts that a change may rewrite.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another change has made a version since this one began."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> int:
    """The number of the newest version; 0 where there is none."""
    p, fs = _fs(spark, f"{root}/versions")
    if not fs.exists(p):
        return 0
    return max((int(s.getPath().getName()[1:6]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), default=0)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """{table: {schema, buckets: {n: folder}}} of a version, the newest unless given."""
    n = latest(spark, root) if version is None else version
    return json.loads(spark.read.text(f"{root}/versions/v{n:05d}.json", wholetext=True).first()[0]) if n else {}


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame | None:
    """A table as it is in a version; None if it is in none."""
    m = manifest(spark, root, version).get(table)
    return None if m is None else _rows(spark, root, table, m, sorted(m["buckets"]))


def _rows(spark: SparkSession, root: str, table: str, m: dict, buckets: list[str]) -> DataFrame:
    paths = [f"{root}/data/{table}/{m['buckets'][b]}/bucket={b}" for b in buckets if b in m["buckets"]]
    return spark.read.schema(m["schema"]).parquet(*paths) if paths else spark.createDataFrame([], m["schema"])


def prepare(spark: SparkSession, root: str, table: str, new: DataFrame, key: list[str], now: dict) -> dict:
    """The table's part of the next version: the rows of new stand in place of all rows that have one of their keys. Its buckets are written, and no reader sees them yet."""
    bucket = F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
    m = now.get(table, {"schema": schema, "buckets": {}})
    if m["schema"] != schema:
        raise ValueError(f"{table} has the columns {m['schema']}")
    touched = sorted(str(r[0]) for r in new.select(bucket).distinct().collect())  # BUCKETS rows at most
    old = _rows(spark, root, table, m, touched).join(new.select(*key).distinct(), key, "left_anti").select(*new.columns)
    change = uuid.uuid4().hex
    rows = old.unionByName(new).withColumn("bucket", bucket)
    if touched:
        # a bucket may be some tasks, as a hot key may fill it
        rows.repartition("bucket", F.pmod(F.xxhash64(*new.columns), F.lit(4))).write.partitionBy("bucket").parquet(f"{root}/data/{table}/{change}")
    return {"schema": schema, "buckets": {**m["buckets"], **{b: change for b in touched}}}


def publish(spark: SparkSession, root: str, parts: dict, began: int) -> int:
    """Makes the version after began, in which the tables of parts are as prepared and all others as before; Conflict if there is one already."""
    whole = {**manifest(spark, root, began), **parts}
    p, fs = _fs(spark, f"{root}/versions/v{began + 1:05d}.json")
    # written beside it first, so that a version is never half there; the move is refused where the number is taken
    draft, _ = _fs(spark, f"{root}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(whole, sort_keys=True).encode()))
    out.close()
    fs.mkdirs(p.getParent())
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    keep = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(draft, p, keep)
    except Exception as e:
        fs.delete(draft, False)
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {began + 1} is there") from None
        raise
    return began + 1


def change(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> int:
    """Replaces rows in several tables at once: {table: (new rows, key)}. Gives the number of the version in which all of it is there."""
    began = latest(spark, root)
    now = manifest(spark, root, began)
    return publish(spark, root, {name: prepare(spark, root, name, new, key, now) for name, (new, key) in tables.items()}, began)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes the folders that none of the newest keep versions names, and gives their number. Only where no change is under way."""
    n = latest(spark, root)
    named = {(t, f) for v in range(max(1, n - keep + 1), n + 1) for t, m in manifest(spark, root, v).items() for f in m["buckets"].values()}
    data, fs = _fs(spark, f"{root}/data")
    gone = [c.getPath() for t in (fs.listStatus(data) if fs.exists(data) else []) for c in fs.listStatus(t.getPath()) if (t.getPath().getName(), c.getPath().getName()) not in named]
    for p in gone:
        fs.delete(p, True)
    return len(gone)

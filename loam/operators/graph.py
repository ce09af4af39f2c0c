"""The property graph: content-addressed vertices, keyed edges, and set-based upserts.

A vertex is ``(collection, _key, attrs)`` with the unique key's value as ``_key``; an
edge is ``(collection, _key, _from, _to, ssdeep_distance)``. An upsert takes a whole
batch: what is stored stays unchanged, and of rows that repeat a key the first by the
given order wins.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from loam import schema
from loam.storage import spool


def vertex_id(collection: Column | str, key: Column | str) -> Column:
    return F.concat_ws("/", collection, key)


def edge_key(source: Column | str, target: Column | str) -> Column:
    """``from--to`` with slashes as minus signs."""
    part = lambda c: F.replace(F.col(c) if isinstance(c, str) else c, F.lit("/"), F.lit("-"))
    return F.concat_ws("--", part(source), part(target))


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the least by ``order``; aggregates map-side, so a hot key stays cheap."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = [c for c in order if c not in keys] or rest
    # Maps have no order; their text has.
    by = [F.to_json(c) if dict(rows.dtypes)[c].startswith("map") else F.col(c) for c in ordered]
    if not rest:
        return rows.dropDuplicates(keys)
    best = F.min_by(F.struct(*rest), F.struct(*by)).alias("row")
    return rows.groupBy(*keys).agg(best).select(*keys, "row.*").select(rows.columns)


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``stored`` and the new rows of ``incoming``, with a ``created`` flag."""
    fresh = first_by_key(incoming, keys, order or []).join(stored.select(*keys), keys, "left_anti")
    return stored.withColumn("created", F.lit(False)).unionByName(fresh.withColumn("created", F.lit(True)))


def upsert_result(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """For each key of ``incoming`` the row that holds after the upsert, and whether it was created."""
    batch = first_by_key(incoming, keys, [])
    known = stored.join(batch.select(*keys), keys, "left_semi").withColumn("created", F.lit(False))
    fresh = batch.join(stored.select(*keys), keys, "left_anti").withColumn("created", F.lit(True))
    return known.unionByName(fresh)


def upsert_vertices(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["collection", "_key"])


def edges(rows: DataFrame, collection: str, source: Column, target: Column) -> DataFrame:
    return rows.select(
        F.lit(collection).alias("collection"), edge_key(source, target).alias("_key"), source.alias("_from"), target.alias("_to"),
        F.lit(None).cast("long").alias("ssdeep_distance"),
    )


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["collection", "_key"])


def get_document(rows: DataFrame, key: str, value: object, order: str | None = None) -> DataFrame:
    """The first row by ``order`` whose ``key`` has the value."""
    found = rows.where(F.col(key) == F.lit(value))
    return found.orderBy(order or key).limit(1)


def find_document(rows: DataFrame, key: str, value: object) -> dict:
    found = get_document(rows, key, value).first()
    if found is None:
        raise LookupError(f"no document with {key} = {value!r}")
    return found.asDict()


def unique_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a null key part don't count (a sparse index)."""
    there = rows.dropna(subset=keys)
    return there.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def domain_violations(all_edges: DataFrame, vertices: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges whose end collections their definition doesn't allow, or whose ends don't exist."""
    ends = all_edges.withColumns({"from": F.split_part("_from", F.lit("/"), F.lit(1)), "to": F.split_part("_to", F.lit("/"), F.lit(1))})
    disallowed = ends.join(definitions, ["collection", "from", "to"], "left_anti").drop("from", "to").withColumn("reason", F.lit("definition"))
    ids = vertices.select(vertex_id("collection", "_key").alias("id"))
    loose = [
        all_edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select(*all_edges.columns, F.lit(end).alias("reason"))
        for end in ("_from", "_to")
    ]
    return disallowed.select(*all_edges.columns, "reason").unionByName(loose[0]).unionByName(loose[1])


def edge_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(schema.EDGE_DEFINITIONS), "collection string, `from` string, `to` string")


def closure(links: DataFrame, depth: int | None = None) -> DataFrame:
    """``(ancestor, descendant, depth)`` of all paths, or of those up to ``depth``, the shortest path's length each.

    Paths double: one of length in (r, 2r] is a shortest path of length r and one of at
    most r from there on, so the rounds grow with the logarithm of the depth; cycles end
    them, as no shortest path is longer than the nodes are many.
    """
    step = links.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
    known, reach = spool(step.withColumn("depth", F.lit(1)), "closure"), 1
    while depth is None or reach < depth:
        ends = known.where(F.col("depth") == reach).select("ancestor", F.col("descendant").alias("middle"))
        if ends.isEmpty():
            break
        rest = known.select(F.col("ancestor").alias("middle"), "descendant", (F.col("depth") + reach).alias("depth"))
        longer = ends.join(rest, "middle").groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth"))
        if depth is not None:
            longer = longer.where(F.col("depth") <= depth)
        # Pairs that are known have a shorter path.
        known = spool(known.unionByName(longer.join(known, ["ancestor", "descendant"], "left_anti")), "closure")
        reach *= 2
    return known


class ConstraintError(ValueError):
    pass


#: Buckets of keys in a collection, and keys that are looked for by name.
BUCKETS, FEW_KEYS = 16, 10


def _bucket() -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int")


class GraphStore:
    """A corpus in a warehouse folder: ``vertices`` and ``edges``, to which upserts add a version of what they create.

    A version is complete with its success mark and never changes; its rows lie in a
    folder for each collection and bucket of keys, and its files have Bloom filters of the
    keys. An upsert reads the buckets of its own keys only. Readers see the complete versions that no complete one
    replaces. One writer at a time is expected; ``compact`` makes one version of all.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, warehouse: str, name: str) -> GraphStore:
        """The store of the ``focused`` or ``general`` graph below a warehouse folder, created with its collections if it isn't there."""
        database, graph_name = schema.DATABASES[name]
        store = cls(spark, f"{warehouse.rstrip('/')}/{database}/{graph_name}")
        for collection in dict.fromkeys((*schema.ROOT_COLLECTIONS, *schema.SAMPLE_COLLECTIONS)):
            store.ensure_collection(collection, fields=(schema.unique_key(collection),))
        for collection in dict.fromkeys(d[0] for d in schema.EDGE_DEFINITIONS):
            store.ensure_collection(collection, edge=True)
        return store

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ensure_collection(self, collection: str, edge: bool = False, fields: tuple[str, ...] = ()) -> str | None:
        """Make a collection known if it isn't yet, and the unique index over ``fields``; the index's name."""
        index = schema.index_name(collection, list(fields)) if fields else None
        for mark in filter(None, (f"{'edge' if edge else 'document'}={collection}", index and f"index={index}")):
            path = self._path("collections", mark)
            if not self._files(path).exists(path):
                self._files(path).create(path, True).close()
        return index

    def collections(self) -> dict[str, str]:
        """Kinds (``document``, ``edge`` or ``index``) of the names that are known."""
        path = self._path("collections")
        if not self._files(path).exists(path):
            return {}
        marks = [s.getPath().getName() for s in self._files(path).listStatus(path)]
        return {name: kind for kind, _, name in (m.partition("=") for m in marks if not m.startswith("."))}

    def _complete(self, name: str) -> dict[str, int]:
        """Paths and numbers of all complete versions."""
        path = self._path(name)
        if not self._files(path).exists(path):
            return {}
        complete = [s.getPath() for s in self._files(path).listStatus(path) if self._files(path).exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return {str(p): int(p.getName().split("=")[1].split("-")[0]) for p in complete}

    def _versions(self, name: str) -> list[str]:
        numbers = self._complete(name)
        # A compacted version holds all that came before it, whether that is deleted yet or not.
        whole = max((n for p, n in numbers.items() if p.endswith("-whole")), default=-1)
        return sorted(p for p, n in numbers.items() if n > whole or (n == whole and p.endswith("-whole")))

    def _read(self, name: str, shape, where: Column | None = None) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], shape)
        # Named, as versions without rows have no folders to find it in.
        whole = StructType([*shape.fields, StructField("bucket", IntegerType())])
        rows = self.spark.read.schema(whole).option("basePath", f"{self.folder}/{name}").parquet(*versions)
        return (rows if where is None else rows.where(where)).select(shape.fieldNames())

    def touched(self, name: str, keys: DataFrame) -> DataFrame:
        """The stored rows in the buckets of ``keys(collection, _key)``; of a few keys those that the files' filters let through."""
        shape = {"vertices": schema.VERTICES, "edges": schema.EDGES}[name]
        # A row a collection and bucket, however many keys there are.
        places: dict[str, list[int]] = {}
        for r in keys.select("collection", _bucket().alias("bucket")).distinct().collect():
            places.setdefault(r["collection"], []).append(r["bucket"])
        where = F.lit(False)
        for collection, buckets in places.items():
            where = where | ((F.col("collection") == collection) & F.col("bucket").isin(buckets))
        few = [r["_key"] for r in keys.select("_key").distinct().limit(FEW_KEYS + 1).collect()]
        return self._read(name, shape, where & F.col("_key").isin(few) if 0 < len(few) <= FEW_KEYS else where)

    def append(self, name: str, rows: DataFrame, token: str) -> None:
        """Add a version of rows that aren't stored yet; of a token that was appended before, the version is written again."""
        if broken := self.violations(**{name: rows}).limit(3).collect():
            raise ConstraintError("; ".join(f"{r['collection']}/{r['_key']}: {r['reason']}" for r in broken))
        for path in (p for p in self._complete(name) if p.endswith(f"-of-{token}")):
            self._delete(path)
        self._write(name, rows, end=f"-of-{token}")

    def _write(self, name: str, rows: DataFrame, end: str = "") -> str:
        number = max(self._complete(name).values(), default=-1) + 1
        path = f"{self.folder}/{name}/version={number:08d}-{uuid.uuid4().hex[:8]}{end}"
        # One file for each collection and bucket, several where that is large.
        dealt = rows.withColumn("bucket", _bucket()).hint("rebalance", "collection", "bucket")
        dealt.write.option("parquet.bloom.filter.enabled#_key", "true").partitionBy("collection", "bucket").parquet(path)
        return path

    @property
    def vertices(self) -> DataFrame:
        return self._read("vertices", schema.VERTICES)

    @property
    def edges(self) -> DataFrame:
        return self._read("edges", schema.EDGES)

    def violations(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        """``(collection, _key, reason)`` of rows that the store doesn't take.

        Reasons: ``collection`` (not known, or of the other kind), ``key`` (null or empty) and
        ``definition`` (an edge between collections that its definition doesn't allow).
        Before any collection is made known, every collection is.
        """
        known = self.collections()
        found = [self.spark.createDataFrame([], "collection string, _key string, reason string")]
        for rows, kind in ((vertices, "document"), (edges, "edge")):
            if rows is None:
                continue
            names = [n for n, k in known.items() if k == kind]
            reason = F.when(F.coalesce(F.col("_key"), F.lit("")) == "", "key")
            if known:
                reason = reason.when(~F.col("collection").isin(names), "collection")
            if kind == "edge":
                ends = [F.split_part(end, F.lit("/"), F.lit(1)) for end in ("_from", "_to")]
                allowed = [f"{c}/{a}/{b}" for c, a, b in schema.EDGE_DEFINITIONS]
                reason = reason.when(~F.concat_ws("/", "collection", *ends).isin(allowed), "definition")
            found.append(rows.select("collection", "_key", reason.alias("reason")).where("reason is not null"))
        return reduce(DataFrame.unionByName, found)

    def upsert(self, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Add what isn't stored yet; raises ``ConstraintError`` and stores nothing if a row breaks a constraint."""
        # What comes may be expensive, and is read several times.
        vertices, edges = (
            None if rows is None else spool(rows.select(shape.fieldNames()), "incoming") for rows, shape in ((vertices, schema.VERTICES), (edges, schema.EDGES))
        )
        broken = self.violations(vertices, edges).limit(3).collect()
        if broken:
            raise ConstraintError("; ".join(f"{r['collection']}/{r['_key']}: {r['reason']}" for r in broken))
        for name, rows in (("vertices", vertices), ("edges", edges)):
            if rows is not None:
                stored = self.touched(name, rows).select("collection", "_key")
                self._write(name, first_by_key(rows, ["collection", "_key"], []).join(stored, ["collection", "_key"], "left_anti").select(rows.columns))

    def compact(self) -> None:
        """One version of all; from its completion on the older ones aren't read, and then they are deleted."""
        for name, rows in (("vertices", self.vertices), ("edges", self.edges)):
            old = list(self._complete(name))
            if len(old) > 1:
                self._write(name, first_by_key(rows, ["collection", "_key"], []), end="-whole")
                for path in old:
                    self._delete(path)

    def _delete(self, path: str) -> None:
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        self._files(gone).delete(gone, True)

    def init(self, corpus: str, families: tuple[str, ...] = ()) -> None:
        """The corpus node, the family roots and their edges; repeating it changes nothing."""
        self.upsert(*bootstrap(self.spark, corpus, families))


def bootstrap(spark: SparkSession, corpus: str, families: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    names = [(corpus, corpus), *((f, f) for f in families)]
    roots = spark.createDataFrame(names, "collection string, name string").select(
        "collection", F.col("name").alias("_key"), F.create_map(F.lit("name"), "name", F.lit("display_name"), "name").alias("attrs")
    )
    links = spark.createDataFrame([(f,) for f in families], "name string")
    return roots, edges(links, "HasMalwareFamily", F.lit(f"{corpus}/{corpus}"), vertex_id("name", "name"))

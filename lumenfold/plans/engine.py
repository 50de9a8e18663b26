"""Namespaces of documents under one root: the operations of a search service as a library."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators.lexical import Bm25, Corpus
from lumenfold.operators.postings import IndexedCorpus
from lumenfold.operators.vector import ClusterIndex
from lumenfold.sources.readers import bulk_actions
from lumenfold.sources.schema import ROLES, typed
from lumenfold.sources.table import SnapshotTable

from .dsl import request_of, response, script_values
from .search import Request, Result, search


class Namespace:
    """Documents with the given field roles, unique by ``id``; reads see whole versions only.

    ``fields`` has a role for each field: Text fields are searched, all can be filtered, sorted and aggregated. An empty namespace has no hits.
    """

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, str]):
        if unknown := set(fields.values()) - set(ROLES):
            raise ValueError(f"unknown role {sorted(unknown)[0]!r}")
        self.spark, self.fields = spark, dict(fields)
        schema = T.StructType([T.StructField("id", T.StringType(), False), *[T.StructField(n, T.ArrayType(T.FloatType()) if r == "Vector" else {"Boolean": T.BooleanType(), "Integer": T.LongType(), "Float": T.DoubleType()}.get(r, T.StringType())) for n, r in fields.items()]])
        self.table = SnapshotTable(spark, path, ["id"], schema)

    # -- writing

    def _rows(self, docs: DataFrame) -> DataFrame:
        """Native (id, fields) or typed documents as rows; missing fields are null."""
        if "fields" in docs.columns and "fields" not in self.fields:
            extra = [c for c in docs.columns if c not in ("id", "fields")]
            native = typed(docs.select("id", "fields"), self.fields) if not extra else typed_with(docs, self.fields, extra)
            return native
        have = {f.name: f.dataType for f in self.table.schema.fields}
        keep = [c for c in docs.columns if c not in have]
        return docs.select(*[(F.col(n) if n in docs.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()], *keep)

    def index(self, docs: DataFrame, order: str | None = None) -> int:
        """Upserts whole documents; the last in ``order`` of several with one id counts. Returns the new version."""
        return self.table.upsert(self._rows(docs), order)

    def replace(self, docs: DataFrame, order: str | None = None) -> int:
        """Sets the non-null fields of ``docs`` in the documents of their ids, and adds missing ones."""
        return self.table.patch(self._rows(docs), order)

    def bulk(self, lines: Sequence[str]) -> int:
        """A bulk body: its whole documents, then its updates, each in the order given. See ``bulk_items`` for what came of each action."""
        whole, updates = bulk_actions(self.spark, list(lines))
        version = self.table.version()
        if not whole.isEmpty():
            version = self.index(whole, "seq")
        if not updates.isEmpty():
            version = self.replace(updates, "seq")
        return version

    def publish(self, docs: DataFrame, mode: str = "append", order: str | None = None) -> int:
        """A migrated collection: upserted into what is there ("append"), or in its place at once ("replace")."""
        if mode not in ("append", "replace"):
            raise ValueError(f"mode is append or replace, not {mode!r}")
        return self.index(docs, order) if mode == "append" else self.table.replace_all(self._rows(docs), order)

    def delete(self, clause: Mapping) -> int:
        """Deletes what a filter matches, durably."""
        return self.table.delete_by_query(clause)

    def update(self, clause: Mapping, script: Mapping) -> int:
        """Runs an update script over what a filter matches."""
        return self.table.update_by_query(clause, script_values(script))

    def compact(self, full: bool = False, **policy) -> int | None:
        return self.table.compact(full, **policy)

    def import_segments(self, overwrite: bool = False) -> int:
        """A manifest from the segments found under the path."""
        return self.table.rebuild_manifest(overwrite)

    # -- reading

    def _texts(self) -> list[str]:
        text = [n for n, r in self.fields.items() if r == "Text"]
        if not text:
            raise ValueError("no Text field to search")
        return text

    def build_index(self) -> IndexedCorpus:
        """Postings and statistics of the latest version, which searches of that version use from then on; other versions are searched by a scan."""
        version = self.table.version()
        return IndexedCorpus.write(self.table.read(version), "id", self._texts(), f"{self.table.path}/index/{version:010d}")

    def build_clusters(self, field: str) -> ClusterIndex:
        """Clusters of a vector field of the latest version, for requests with ``num_candidates``."""
        version = self.table.version()
        rows = self.table.read(version).select("id", field)
        return ClusterIndex.build(rows, "id", field).save(f"{self.table.path}/clusters/{version:010d}-{field}")

    def corpus(self, version: int | None = None) -> Corpus | IndexedCorpus:
        version = self.table.version() if version is None else version
        path = f"{self.table.path}/index/{version:010d}"
        if self.table.has(f"{path}/totals/_SUCCESS"):
            return IndexedCorpus(self.table.read(version), "id", self._texts(), path)
        return Corpus.of(self.table.read(version), "id", self._texts())

    def search(self, request: Request | Mapping, fields: Sequence[str] | None = None) -> Result:
        """A request, or a body of the JSON query DSL."""
        request = request if isinstance(request, Request) else request_of(request)
        clusters = None
        if request.knn and request.knn.get("num_candidates"):
            path = f"{self.table.path}/clusters/{self.table.version():010d}-{request.knn['field']}"
            if self.table.has(f"{path}/centroids/_SUCCESS"):
                clusters = ClusterIndex.open(self.spark, path, "id")
        return search(self.corpus(), request, fields, clusters)

    def query(self, q: str, max_results: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """The page of a plain text query, all terms required."""
        return self.search(Request(q, max_results, bm25=Bm25(k1, b))).page

    def respond(self, body: Mapping, index: str = "documents") -> dict:
        """The response of a DSL body, in its shape."""
        return response(self.search(body), index, "id")

    def count(self, body: Mapping | None = None) -> int:
        """Documents that a DSL body matches; all without one."""
        if body is None:
            return self.table.read().count()
        return self.search(body).hits.count()

    def exists(self, ids: Iterable[str]) -> tuple[list[str], list[str]]:
        """(existing, missing) of the ids asked for."""
        asked = list(dict.fromkeys(ids))
        frame = self.spark.createDataFrame([(i,) for i in asked], "id string")
        found = {r["id"] for r in self.table.exists(frame).where("found").select("id").collect()}  # at most as many as asked for
        return [i for i in asked if i in found], [i for i in asked if i not in found]

    def stats(self) -> dict:
        return self.table.stats()


def typed_with(docs: DataFrame, fields: Mapping[str, str], extra: Sequence[str]) -> DataFrame:
    """``typed`` documents with further columns of the input."""
    names = dict(fields)
    packed = docs.select(F.struct("id", *extra).alias("id"), "fields")
    return typed(packed, names).select("id.id", *names, *[F.col(f"id.{c}").alias(c) for c in extra])


class Engine:
    """All namespaces under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def namespace(self, name: str, fields: Mapping[str, str]) -> Namespace:
        if not name or any(c in name for c in "/\\") or name.startswith("."):
            raise ValueError(f"{name!r} is no name of a namespace")
        return Namespace(self.spark, f"{self.root}/{name}", fields)

    def names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()) if fs.exists(path) else []

    def stats(self) -> DataFrame:
        """(namespace, documents, segments, version) of the latest versions; replaced and deleted documents don't count."""
        out = []
        for n in self.names():
            s = SnapshotTable(self.spark, f"{self.root}/{n}", ["id"], T.StructType([T.StructField("id", T.StringType())])).stats()
            out.append((n, s["documents"], s["segments"], s["version"]))
        return self.spark.createDataFrame(out, "namespace string, documents bigint, segments int, version int")

"""A versioned table of Parquet segments: upsert, patch, durable delete, compaction, snapshots."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.operators.filters import predicate


#: Tries of a commit where other writers come first; bytes of a merged segment; the folder of files that name what a merge replaced.
ATTEMPTS, MERGED_BYTES, REPLACED = 8, 5 << 30, "replaced"


def _commit_of(kind: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/{kind}/([0-9]{{10}})-[0-9a-f]{{32}}/[^/]*$", 1).cast("bigint")


class Conflict(RuntimeError):
    """Another writer published the version first."""


class SnapshotTable:
    """Rows of ``schema`` under ``path``, unique by ``keys``.

    A version is a manifest that lists segments and delete files, each with the number of the commit that wrote it; a delete
    covers rows of its keys from earlier commits. A commit makes the next manifest's file appear whole and exclusively; of two writers the
    second tries again on top of the first, so nothing is lost. Readers keep the version they opened.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), list(keys), schema

    # -- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/versions/{version:010d}.json"

    def version(self) -> int:
        return max([int(n[:-5]) for n in self._list(f"{self.path}/versions") if n.endswith(".json") and not n.startswith(".")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "segments": [], "deletes": []}
        return json.loads("".join(r[0] for r in self.spark.read.text(self._manifest_path(version), wholetext=True).collect()))

    def has(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def publish(self, manifest: dict) -> int:
        """Makes the next version's file appear whole and only where there is none, or raises Conflict."""
        manifest = manifest | {"version": manifest["version"] + 1, "at": datetime.now(timezone.utc).isoformat()}
        target = self._manifest_path(manifest["version"])
        if not self._create(target, json.dumps(manifest).encode()):
            raise Conflict(f"version {manifest['version']} exists")
        return manifest["version"]

    def _create(self, path: str, data: bytes) -> bool:
        """Whether this call made the file. Local: a link to a finished file; object stores: conditional create, which shows the object when it is closed; else a rename."""
        jvm = self.spark._jvm
        fs, p = self._fs(path)
        if fs.exists(p):
            return False
        scheme = fs.getUri().getScheme()
        if scheme == "s3a":
            try:
                out = fs.createFile(p).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build()
                out.write(bytearray(data))
                out.close()
            except Exception as e:
                if any(x in str(e) for x in ("FileAlreadyExists", "412", "409")):
                    return False
                raise
            return True
        temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(data))
        out.close()
        try:
            if scheme == "file":
                place = lambda x: jvm.java.nio.file.Paths.get(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(x).toString(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(place(p), place(temporary))
            else:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temporary, p, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(temporary, False)

    def _retried(self, once: Callable[[], int]) -> int:
        """``once`` reads the latest version and publishes the next; where another writer was first it runs again."""
        for _ in range(ATTEMPTS - 1):
            try:
                return once()
            except Conflict:
                continue
        return once()

    # -- reading

    def _segments(self, manifest: dict) -> DataFrame:
        """All segments in one scan; a row's commit is in its file's path."""
        if not manifest["segments"]:
            return self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0).cast("bigint"))
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{s['path']}" for s in manifest["segments"]])
        return rows.withColumn("_seq", _commit_of("segments"))

    def _deletes(self, manifest: dict) -> DataFrame | None:
        if not manifest["deletes"]:
            return None
        gone = self.spark.read.parquet(*[f"{self.path}/{d['path']}" for d in manifest["deletes"]]).withColumn("_until", _commit_of("deletes"))
        return gone.groupBy(*self.keys).agg(F.max("_until").alias("_until"))

    def _live(self, manifest: dict) -> DataFrame:
        rows, gone = self._segments(manifest), self._deletes(manifest)
        if gone is None:
            return rows
        both = rows.join(gone.withColumnsRenamed({k: f"_k_{k}" for k in self.keys}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys], "left")
        return both.where("_until is null or _until <= _seq").select(*rows.columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest by default)."""
        return self._live(self.manifest(version)).drop("_seq")

    # -- writing

    def _names(self) -> list[str]:
        return [f.name for f in self.spark.createDataFrame([], self.schema).schema]

    def _segment(self, rows: DataFrame, seq: int) -> dict:
        path = f"segments/{seq:010d}-{uuid.uuid4().hex}"
        rows.select(*[F.col(n) for n in self._names()]).write.parquet(f"{self.path}/{path}")
        return self._described(path, seq)

    def _described(self, path: str, seq: int) -> dict:
        fs, p = self._fs(f"{self.path}/{path}")
        return {"path": path, "seq": seq, "rows": self.spark.read.schema(self.schema).parquet(f"{self.path}/{path}").count(), "bytes": fs.getContentSummary(p).getLength()}

    def _commit(self, base: dict, rows: Sequence[DataFrame], gone: DataFrame | None, replaced: dict | None = None) -> int:
        seq = base["version"] + 1
        new = replaced or {"version": base["version"], "segments": list(base["segments"]), "deletes": list(base["deletes"])}
        if gone is not None:
            path = f"deletes/{seq:010d}-{uuid.uuid4().hex}"
            gone.select(*self.keys).distinct().write.parquet(f"{self.path}/{path}")
            new["deletes"].append({"path": path, "seq": seq})
        made = [self._segment(r, seq) for r in rows]
        if replaced is not None:
            # An import that finds no manifest goes by this file.
            dropped = [s["path"] for k in ("segments", "deletes") for s in base[k] if s not in new[k]]
            for s in made[:1]:
                self._create(f"{self.path}/{REPLACED}/{s['path'].split('/')[1]}.json", json.dumps(dropped).encode())
        new["segments"] += made
        # A delete covers rows of earlier commits; where none is left it has nothing to do.
        oldest = min((s["seq"] for s in new["segments"]), default=seq + 1)
        new["deletes"] = [d for d in new["deletes"] if d["seq"] > oldest]
        try:
            return self.publish(new)
        except Conflict:
            # What was written for a version that never came is removed, so that an import doesn't find it.
            for path in [s["path"] for s in made] + [d["path"] for d in new["deletes"] if d["seq"] == seq] + [f"{REPLACED}/{s['path'].split('/')[1]}.json" for s in made]:
                fs, p = self._fs(f"{self.path}/{path}")
                fs.delete(p, True)
            raise

    def _ordered(self, rows: DataFrame, order: str | None) -> tuple[DataFrame, str]:
        """``rows`` and the column that orders them: as they came in, where none is given."""
        return (rows, order) if order else (rows.withColumn("_order", F.monotonically_increasing_id()), "_order")

    def last_wins(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row for each key: the one latest in ``order``, or the last that came in."""
        rows, by = self._ordered(rows, order)
        w = Window.partitionBy(*self.keys).orderBy(F.col(by).desc_nulls_last())
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_order")

    def folded(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row for each key: of every column the latest value that isn't null."""
        rows, by = self._ordered(rows, order)
        names = [n for n in self._names() if n in rows.columns and n not in self.keys]
        return rows.groupBy(*self.keys).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(F.col(by).isNotNull(), by))).alias(n) for n in names] or [F.count("*").alias("_c")])

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Replaces rows by key; of several in ``rows`` the latest in ``order`` counts, or the last that came in. Older segments aren't rewritten."""

        def once() -> int:
            base = self.manifest()
            new = self.last_wins(rows, order)
            return self._commit(base, [new], new if base["segments"] else None)

        return self._retried(once)

    def patch(self, rows: DataFrame, order: str | None = None) -> int:
        """Sets the non-null values of ``rows`` in the rows of their keys; missing keys are added. Several patches of a key are applied one after another."""

        def once() -> int:
            base, names = self.manifest(), self._names()
            new = self.folded(rows, order)
            old = self._live(base).drop("_seq").withColumnsRenamed({c: f"_old_{c}" for c in names})
            both = new.join(old, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in self.keys], "left")
            merged = both.select(*[(F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in new.columns else F.col(f"_old_{c}")).alias(c) for c in names])
            return self._commit(base, [merged], new if base["segments"] else None)

        return self._retried(once)

    def replace_all(self, rows: DataFrame, order: str | None = None) -> int:
        """Publishes ``rows`` in place of everything there is; readers see the old version until then."""

        def once() -> int:
            base = self.manifest()
            return self._commit(base, [self.last_wins(rows, order)], None, {"version": base["version"], "segments": [], "deletes": []})

        return self._retried(once)

    def delete_by_query(self, clause: Mapping) -> int:
        """Deletes the rows that match a filter, in a file that later versions keep while they have older segments."""

        def once() -> int:
            base = self.manifest()
            rows = self.read(base["version"])
            return self._commit(base, [], rows.where(predicate(rows, clause)))

        return self._retried(once)

    def update_by_query(self, clause: Mapping, values: Mapping[str, Column | Callable[[DataFrame], Column]]) -> int:
        """Sets columns of the rows that match, each from an expression over the old row."""

        def once() -> int:
            base = self.manifest()
            rows = self.read(base["version"])
            hit = rows.where(predicate(rows, clause))
            new = hit.withColumns({c: v(hit) if callable(v) and not isinstance(v, Column) else v for c, v in values.items()})
            return self._commit(base, [new], hit)

        return self._retried(once)

    # -- maintenance

    def merge_inputs(self, max_rows: int = 50_000, max_inputs: int = 32, max_total: int | None = None, max_bytes: int = MERGED_BYTES) -> list[dict]:
        """Segments to merge: those below ``max_rows``, smallest first, up to ``max_inputs`` and while rows and bytes stay within ``max_total`` and ``max_bytes``."""
        out, total, size = [], 0, 0
        for s in sorted((s for s in self.manifest()["segments"] if s["rows"] < max_rows), key=lambda s: (s["rows"], s["path"])):
            if len(out) == max_inputs or (max_total is not None and total + s["rows"] > max_total) or size + s["bytes"] > max_bytes:
                break
            out.append(s)
            total, size = total + s["rows"], size + s["bytes"]
        return out if len(out) >= 2 else []

    def needs_compaction(self, trigger: int = 8, max_rows: int = 50_000) -> bool:
        return sum(s["rows"] < max_rows for s in self.manifest()["segments"]) >= trigger

    def merge_groups(self, max_bytes: int | None) -> list[list[dict]]:
        """All segments in order, cut into runs of up to ``max_bytes``; one run without that bound."""
        groups: list[list[dict]] = []
        for s in sorted(self.manifest()["segments"], key=lambda s: s["path"]):
            if groups and (not max_bytes or sum(x["bytes"] for x in groups[-1]) + s["bytes"] <= max_bytes):
                groups[-1].append(s)
            else:
                groups.append([s])
        return groups

    def compact(self, full: bool = False, partitions: int | None = None, **policy) -> int | None:
        """Merges small segments, or all with their deletes (into runs of up to ``max_bytes``); None if there is nothing to do. Deletes that land meanwhile are met by a new try."""

        def once() -> int | None:
            base = self.manifest()
            groups = self.merge_groups(policy.get("max_bytes")) if full else [g for g in [self.merge_inputs(**policy)] if g]
            if not groups:
                return None
            paths = {s["path"] for g in groups for s in g}
            # Rows keep no commit number of their own: what is deleted goes, and the rest is as new as this commit.
            live = [self._live({"version": base["version"], "segments": g, "deletes": base["deletes"]}).drop("_seq") for g in groups]
            kept = {"version": base["version"], "segments": [s for s in base["segments"] if s["path"] not in paths], "deletes": list(base["deletes"])}
            return self._commit(base, [r.coalesce(partitions) if partitions else r for r in live], None, kept)

        return self._retried(once)

    def rebuild_manifest(self, overwrite: bool = False) -> int:
        """A manifest of the segment and delete folders, for an imported table, without those that a merge replaced; Conflict if there is one and not ``overwrite``."""
        if self.version() and not overwrite:
            raise Conflict("the table has a manifest")
        found = {kind: sorted(n for n in self._list(f"{self.path}/{kind}")) for kind in ("segments", "deletes")}
        dropped: set[str] = set()
        for n in found["segments"]:
            if self.has(path := f"{self.path}/{REPLACED}/{n}.json"):
                dropped |= set(json.loads("".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())))
        seq = lambda n: int(n.split("-")[0])
        new = {"segments": [self._described(f"segments/{n}", seq(n)) for n in found["segments"] if f"segments/{n}" not in dropped], "deletes": [{"path": f"deletes/{n}", "seq": seq(n)} for n in found["deletes"] if f"deletes/{n}" not in dropped]}
        base = max([self.version(), *(seq(n) for k in found.values() for n in k)])
        return self.publish({"version": base} | new)

    def removable(self) -> list[str]:
        """Folders that the latest version doesn't read; older versions may."""
        m = self.manifest()
        used = {x["path"] for k in ("segments", "deletes") for x in m[k]}
        return [f"{kind}/{n}" for kind in ("segments", "deletes") for n in sorted(self._list(f"{self.path}/{kind}")) if f"{kind}/{n}" not in used]

    def vacuum(self) -> list[str]:
        """Removes what ``removable`` lists. No reader of an older version and no writer may be at work."""
        gone = self.removable()
        for path in gone:
            fs, p = self._fs(f"{self.path}/{path}")
            fs.delete(p, True)
        return gone

    def exists(self, ids: DataFrame) -> DataFrame:
        """``ids`` (the key columns) with ``found``."""
        live = self.read().select(*self.keys).distinct().withColumn("found", F.lit(True))
        return ids.join(live, self.keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))

    def stats(self) -> dict:
        """Live rows, segments and version."""
        m = self.manifest()
        return {"documents": self.read(m["version"]).count(), "segments": len(m["segments"]), "version": m["version"]}

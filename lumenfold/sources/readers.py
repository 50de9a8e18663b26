"""Reading documents: JSON lines, bulk action streams, raw vector shards."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import NATIVE, field_of


def read_jsonl(spark: SparkSession, path: str, shorthand: bool | None = None) -> DataFrame:
    """(id, fields) of JSON lines, native ``{id, fields: [...]}`` or shorthand ``{id, name: value, ...}``; told by the line without ``shorthand``.

    A line that isn't a JSON object with an id raises; rows are never dropped.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [parse_document(line, shorthand) for line in part["value"] if line.strip()]
            yield pd.DataFrame({"id": [r["id"] for r in rows], "fields": [r["fields"] for r in rows]})

    return spark.read.text(path).mapInPandas(run, NATIVE)


def parse_document(line: str, shorthand: bool | None = None) -> dict:
    doc = json.loads(line)
    if not isinstance(doc, dict) or not isinstance(doc.get("id"), (str, int)):
        raise ValueError(f"a document is an object with an id: {line[:80]}")
    if shorthand is False or shorthand is None and isinstance(doc.get("fields"), list):
        return {"id": str(doc["id"]), "fields": [{k: f[k] for k in ("name", "field_type", "value")} for f in doc["fields"]]}
    fields = (field_of(k, v) for k, v in doc.items() if k != "id")
    return {"id": str(doc["id"]), "fields": [f for f in fields if f]}


def parse_bulk(lines: list[str]) -> list[dict]:
    """Actions of a bulk body in order: (op, id, index, fields, status). index, create and update take the next line.

    A delete has status 501 and isn't applied, while the rest of the body is; other actions have 200, or 201 for create. A line
    that is no action, or an unknown one, raises.
    """
    out, it = [], iter([x for x in lines if x.strip()])
    for line in it:
        head = json.loads(line)
        if not isinstance(head, dict) or len(head) != 1:
            raise ValueError(f"one action a line: {line[:80]}")
        (op, meta), = head.items()
        if op not in ("index", "create", "update", "delete"):
            raise ValueError(f"unknown action {op!r}")
        action = {"op": op, "id": str(meta["_id"]), "index": meta.get("_index"), "fields": [], "status": {"delete": 501, "create": 201}.get(op, 200)}
        if op != "delete":
            body = next(it, None)
            if body is None:
                raise ValueError(f"no document after {line[:80]}")
            doc = json.loads(body)
            if op == "update":
                doc = doc.get("doc", {})
            action["fields"] = [f for f in (field_of(k, v) for k, v in doc.items()) if f]
        out.append(action)
    return out


def bulk_items(lines: list[str]) -> list[dict]:
    """One item for each action of a bulk body, in the response's shape."""
    return [{a["op"]: {"_id": a["id"], "status": a["status"]} | ({"_index": a["index"]} if a["index"] else {}) | ({"error": "delete by query instead"} if a["status"] == 501 else {})} for a in parse_bulk(lines)]


def bulk_actions(spark: SparkSession, lines: list[str]) -> tuple[DataFrame, DataFrame]:
    """(upserts, patches) of a bulk body, each (id, fields, seq) in the order given."""
    rows = [(k, a["op"], a["id"], a["fields"]) for k, a in enumerate(parse_bulk(lines)) if a["status"] != 501]
    df = spark.createDataFrame(rows, "seq int, op string, id string, fields array<struct<name: string, field_type: string, value: string>>")
    return df.where("op <> 'update'").drop("op"), df.where("op = 'update'").drop("op")


def read_vector_shards(spark: SparkSession, vectors: str, ids: str, dim: int) -> DataFrame:
    """(id, embedding) of raw little-endian float32 shards and their id lists (one a line), paired by name.

    A shard whose numbers of ids and of vectors differ raises.
    """
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    v = spark.read.format("binaryFile").load(vectors).select(stem("path").alias("stem"), F.col("content").alias("v"))
    i = spark.read.format("binaryFile").load(ids).select(stem("path").alias("stem"), F.col("content").alias("i"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, raw, text in part[["stem", "v", "i"]].itertuples(index=False, name=None):
                x, names = np.frombuffer(raw if raw is not None else b"", "<f4"), (text if text is not None else b"").decode().split("\n")
                names = [n for n in names if n]
                if len(x) != dim * len(names):
                    raise ValueError(f"shard {name}: {len(names)} ids, {len(x)} numbers of {dim} a vector")
                yield pd.DataFrame({"id": names, "embedding": list(x.reshape(-1, dim))})

    return v.join(i, "stem", "full_outer").select("stem", "v", "i").mapInPandas(run, "id string, embedding array<float>")

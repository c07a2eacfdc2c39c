"""Integrity and provenance of what is written: manifests with digests, source identities, reuse of finished stages."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources import files

VERSION = 1
NAME = "manifest.json"
#: Tables that every index has, and those of an index with facets.
CORE, FACETED = ("vectors", "centroids"), ("postings",)
SCHEMA = {"vectors": "row_id, id, v, code, cluster_id", "centroids": "cluster_id, c", "postings": "facet, key, row_id"}
#: Folders that are corpus and no index state.
APART = ("store",)


def _entries(spark: SparkSession, path: str) -> dict[str, str]:
    root = path.rstrip("/")
    out = {}
    for folder in files.listed(spark, root):
        name = folder.rsplit("/", 1)[-1]
        if name in APART or name == NAME or name.endswith(".json"):
            continue
        for r in files.hashes(spark, folder).collect():  # one row a file
            at = r["path"].split(f"/{name}/", 1)[-1]
            if not at.rsplit("/", 1)[-1].startswith(("_", ".")):
                out[f"{name}/{at}"] = r["sha256"]
    return out


def write(spark: SparkSession, path: str, meta: dict | None = None) -> dict:
    """Digests of all files of an index, written last."""
    names = {f.rsplit("/", 1)[-1] for f in files.listed(spark, path)}
    m = {"version": VERSION, "schema": SCHEMA, "has_filter": "postings" in names, **(meta or {}), "files": _entries(spark, path)}
    files.write_text(spark, f"{path}/{NAME}", json.dumps(m, indent=1, sort_keys=True))
    return m


def verify(spark: SparkSession, path: str, signature: Callable[[dict], None] | None = None) -> dict:
    """The manifest, after all checks: version, layout, core tables, safe names, digests. ValueError says what is wrong.

    ``signature`` may check who made the manifest; digests alone only show that the files belong to it.
    """
    text = files.read_text(spark, f"{path}/{NAME}")
    if text is None:
        raise ValueError(f"no {NAME} in {path}")
    m = json.loads(text)
    if signature is not None:
        signature(m)
    if m.get("version") != VERSION:
        raise ValueError(f"unsupported index version {m.get('version')!r}")
    if m.get("schema", SCHEMA) != SCHEMA:
        raise ValueError("the index has another layout")
    listed = m.get("files")
    if not isinstance(listed, dict):
        raise ValueError(f"{NAME} lists no files")
    present = {name.split("/", 1)[0] for name in listed}
    for need in CORE + (FACETED if m.get("has_filter") else ()):
        if need not in present:
            raise ValueError(f"{NAME} has no digest for {need}")
    if m.get("has_filter") is False and "postings" in {f.rsplit("/", 1)[-1] for f in files.listed(spark, path)}:
        raise ValueError("the index has facets that its manifest denies")
    for name in listed:
        if name.startswith("/") or ".." in name.split("/") or ":" in name:
            raise ValueError(f"unsafe file name {name!r}")
    found = _entries(spark, path)
    for name, want in listed.items():
        if found.get(name) != want:
            raise ValueError(f"corrupt index file {name}")
    return m


def check_counts(m: dict, n_docs: int, n_centroids: int) -> None:
    for key, n in (("n_docs", n_docs), ("n_centroids", n_centroids)):
        if key in m and m[key] != n:
            raise ValueError(f"{key} is {n}, the manifest says {m[key]}")


IDENTITY = ("docs_sha256", "vectors_sha256", "n_docs", "n_centroids", "dim", "seed")


def same_source(a: dict | None, b: dict | None) -> bool:
    """Whether two provenance records speak of the same inputs; paths play no part, and a missing record is none."""
    return bool(a) and bool(b) and all(a.get(k) == b.get(k) for k in IDENTITY)


def write_provenance(spark: SparkSession, artifact: str, record: dict) -> None:
    files.write_text(spark, artifact.rstrip("/") + ".provenance.json", json.dumps(record, sort_keys=True))


def read_provenance(spark: SparkSession, artifact: str) -> dict | None:
    try:
        got = json.loads(files.read_text(spark, artifact.rstrip("/") + ".provenance.json") or "null")
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def reusable(spark: SparkSession, artifact: str, inputs: dict) -> bool:
    """Whether a finished artifact was made from exactly these inputs."""
    known = read_provenance(spark, artifact)
    return known is not None and files.exists(spark, artifact) and all(known.get(k) == v for k, v in inputs.items())

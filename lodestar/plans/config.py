"""Configuration: the operating point, hardware presets, and a strict check of every key and type."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import SparkSession

from ..sources import files

DIM = 256
CLUSTERS = {"small": 1024, "medium": 10_000, "large": 30_000}
POINT = {"nprobe": 8, "top_coarse": 50, "max_pair_tokens": 64, "batch_size": 32, "max_query_tokens": 32, "budget_ms": 100.0, "k": 10}
EMBEDDER, RERANKER = "hash", "lexical"


@dataclass(frozen=True)
class Hardware:
    name: str = "default"
    usable_vram_gb: float = 96.0
    usable_ram_gb: float = 160.0
    n_cpu: int = 4

    @property
    def tier(self) -> str:
        return "tiny" if self.usable_vram_gb <= 14 else "middle" if self.usable_vram_gb <= 26 else "large"

    @property
    def presets(self) -> dict[str, int]:
        rows = {"tiny": (16, 64, 128, 2048, 25), "middle": (32, 256, 256, 4096, 50), "large": (32, 1024, 256, 8192, 50)}
        return dict(zip(("batch_size", "embed_batch", "max_seq_length", "chunk_size", "top_coarse"), rows[self.tier], strict=True))


_INT, _NUM, _STR, _BOOL = "an integer", "a number", "a string", "a boolean"
SECTIONS: dict[str, dict[str, str]] = {
    "hardware": {"name": _STR, "usable_vram_gb": _NUM, "usable_ram_gb": _NUM, "n_cpu": _INT},
    "models": {"embedder": _STR, "reranker": _STR, "dimensions": _INT},
    "ingest": {"wet_files": _INT, "wet_target_count": _INT},
    "serving": {"nprobe": _INT, "top_coarse": _INT, "max_pair_tokens": _INT, "batch_size": _INT, "max_query_tokens": _INT, "budget_ms": _NUM, "k": _INT},
    "embedding": {"max_seq_length": _INT},
    "resilience": {"resume": _BOOL, "chunk_size": _INT, "embed_batch": _INT},
}
SECTIONS["operating_point"] = SECTIONS["serving"]
#: Counts that make no sense below one.
_POSITIVE = {"nprobe", "top_coarse", "max_pair_tokens", "batch_size", "max_query_tokens", "k", "dimensions", "max_seq_length", "chunk_size", "embed_batch", "n_cpu"}


def _is(value: object, kind: str) -> bool:
    if kind == _BOOL:
        return isinstance(value, bool)
    if kind == _STR:
        return isinstance(value, str)
    return not isinstance(value, bool) and isinstance(value, int if kind == _INT else (int, float))


def validate(raw: object) -> None:
    """ValueError for an unknown key, a wrong type or a value out of range."""
    if not isinstance(raw, dict):
        raise ValueError("a configuration is an object")  # noqa: TRY004
    for section, got in raw.items():
        if section == "hardware_profile":
            if got is not None and not isinstance(got, str):
                raise ValueError("hardware_profile must be a string")
            continue
        known = SECTIONS.get(section)
        if known is None:
            raise ValueError(f"unknown section {section!r}")
        if got is None:
            continue
        if not isinstance(got, dict):
            raise ValueError(f"{section} must be an object")  # noqa: TRY004
        for key, value in got.items():
            if key not in known:
                raise ValueError(f"unknown key {section}.{key}")
            if key == "wet_target_count" and value is None:
                continue
            if not _is(value, known[key]):
                raise ValueError(f"{section}.{key} must be {known[key]}")
            if key in _POSITIVE and value < 1 or key == "budget_ms" and value <= 0:
                raise ValueError(f"{section}.{key} must be positive")


def normalize(raw: dict, fallback: Hardware | None = None) -> dict:
    """The whole configuration: presets of the hardware, overridden by what the caller names."""
    validate(raw)
    own = lambda s: dict(raw.get(s) or {})
    hardware = Hardware(**(asdict(fallback or Hardware()) | own("hardware")))
    p = hardware.presets
    serving = POINT | {k: p[k] for k in ("top_coarse", "batch_size")} | own("serving")
    point = own("operating_point")
    clash = sorted(k for k, v in point.items() if k in own("serving") and own("serving")[k] != v)
    if clash:
        raise ValueError("operating_point and serving disagree on " + ", ".join(clash))
    return {
        "hardware": {f.name: getattr(hardware, f.name) for f in fields(hardware)},
        "models": {"embedder": EMBEDDER, "reranker": RERANKER, "dimensions": DIM} | own("models"),
        "ingest": {"wet_files": 4, "wet_target_count": None} | own("ingest"), "serving": serving, "embedding": {"max_seq_length": p["max_seq_length"]} | own("embedding"),
        "resilience": {"resume": True, "chunk_size": p["chunk_size"], "embed_batch": p["embed_batch"]} | own("resilience"), "operating_point": serving | point,
        "hardware_profile": raw.get("hardware_profile") or hardware.tier,
    }


def load(spark: SparkSession, path: str) -> dict:
    """A configuration file, JSON or (where a parser is there) YAML."""
    text = files.read_text(spark, path)
    if text is None:
        raise ValueError(f"no configuration at {path}")
    if path.endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML needs a parser that is not installed") from e
        return normalize(yaml.safe_load(text))
    return normalize(json.loads(text))


def target_count(config: dict, asked: int | None = None) -> int:
    """How many archive files to take: what the caller asks for, else what the configuration says."""
    n = asked if asked is not None else config["ingest"]["wet_target_count"] or config["ingest"]["wet_files"]
    if n < 1:
        raise ValueError("at least one file is needed")
    return n

"""Index configurations and templates: plain dictionaries to mappings and settings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from typing import Any

from ..functions import analyzers
from .mapping import Field, Mapping

#: The names of field types, and the units of periods in seconds.
TYPES = ("text", "i64", "u64", "f64", "bool", "datetime", "ip", "bytes", "json", "object", "concatenate")
UNITS = {"s": 1, "sec": 1, "second": 1, "m": 60, "min": 60, "minute": 60, "h": 3600, "hour": 3600, "d": 86400, "day": 86400, "w": 604800, "week": 604800}
PRECISIONS = {"seconds": "s", "milliseconds": "ms", "microseconds": "us", "nanoseconds": "us"}

#: Which names indexes, patterns of indexes and fields may have.
_NAME = re.compile(r"^[a-zA-Z][a-zA-Z0-9_.-]{2,254}$")
_PATTERN = re.compile(r"^[a-zA-Z*][a-zA-Z0-9_.*-]{0,254}$")
_FIELD_NAME = re.compile(r"^[@$_\-a-zA-Z0-9][@$_/\.\-a-zA-Z0-9]{0,254}$")


class ConfigError(ValueError):
    pass


def period(text: str) -> int:
    """Seconds of a period such as ``90 days`` or ``2h``."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", text.lower())
    if not m or m[2] not in UNITS:
        raise ConfigError(f"{text!r} is no period")
    return int(m[1]) * UNITS[m[2]]


def check_name(name: str) -> str:
    if not _NAME.match(name):
        raise ConfigError(f"{name!r} is no index name")
    return name


def check_pattern(pattern: str) -> str:
    """One target of a list: a name, or a pattern with single asterisks."""
    bare = pattern.removeprefix("-")
    if not _PATTERN.match(bare) or "**" in bare or ("*" not in bare and len(bare) < 3):
        raise ConfigError(f"{pattern!r} is no index pattern")
    return pattern


#: Its defaults are fixed values too.
@dataclass
class MergePolicy:
    """kind: stable_log, limit_merge or no_merge."""

    kind: str = "stable_log"
    min_level_num_docs: int = 100_000
    merge_factor: int = 10
    max_merge_factor: int = 12
    max_merge_ops: int = 4
    maturation_seconds: int = 48 * 3600


@dataclass
class IndexConfig:
    name: str
    mapping: Mapping
    tags: tuple[str, ...] = ()
    partition_key: str | None = None
    max_partitions: int = 200
    target_docs: int = 10_000_000
    commit_seconds: int = 60
    merge: MergePolicy = field(default_factory=MergePolicy)
    retention_seconds: int | None = None
    sources: dict[str, dict[str, Any]] = field(default_factory=dict)
    raw: dict[str, Any] = field(default_factory=dict)


def _field(spec: dict[str, Any]) -> Field:
    kind = spec["type"]
    array = kind.startswith("array<")
    inner = kind[6:-1] if array else kind
    if inner not in TYPES:
        raise ConfigError(f"unknown field type {kind}")
    out: dict[str, Any] = {"type": inner, "array": array or inner == "concatenate", "fast": bool(spec.get("fast", True)), "record": spec.get("record", "basic" if inner == "text" else "position"), "tokenizer": spec.get("tokenizer", "default")}
    if inner == "datetime":
        out["precision"] = PRECISIONS[spec.get("fast_precision", "seconds")]
        out["formats"] = tuple(f for f in spec.get("input_formats", ()) if f not in ("rfc3339", "iso8601", "rfc2822", "unix_timestamp"))
    if inner == "bytes":
        out["formats"] = (spec.get("input_format", "base64"),)
    if inner == "concatenate":
        out["of"] = tuple(spec["concatenate_fields"])
        out["with_dynamic"] = bool(spec.get("include_dynamic_fields", False))
    return Field(**out)


def _fields(specs: list[dict[str, Any]], prefix: str = "") -> dict[str, Field]:
    out: dict[str, Field] = {}
    for spec in specs:
        if not _FIELD_NAME.match(spec["name"]):
            raise ConfigError(f"{spec['name']!r} is no field name")
        name = prefix + spec["name"]
        own = _fields(spec["field_mappings"], name + ".") if spec["type"] == "object" else {name: _field(spec)}
        if twice := set(own) & set(out):
            raise ConfigError(f"fields declared twice: {sorted(twice)}")
        out |= own
    return out


def load(config: dict[str, Any]) -> IndexConfig:
    """The configuration's meaning; what it lacks takes the defaults above."""
    doc = config.get("doc_mapping", {})
    for t in doc.get("tokenizers", ()):
        options = {k: t[k] for k in ("min_gram", "max_gram", "prefix_only", "pattern") if k in t}
        analyzers.register(t["name"], t["type"], lower=False, filters=tuple(t.get("filters", ())), **options)
    fields = _fields(doc.get("field_mappings", []))
    time = doc.get("timestamp_field")
    if time and (time not in fields or fields[time].type != "datetime"):
        raise ConfigError("the timestamp field has to be a datetime field")
    mapping = Mapping(fields, doc.get("mode", "dynamic"), tuple(config.get("search_settings", {}).get("default_search_fields", ())), time, "_source")
    if mapping.mode not in ("dynamic", "lenient", "strict"):
        raise ConfigError(f"unknown mode {mapping.mode}")
    indexing = config.get("indexing_settings", {})
    merge = dict(indexing.get("merge_policy", {}))
    policy = MergePolicy(merge.pop("type", "stable_log"), **{k: v for k, v in merge.items() if k in MergePolicy.__dataclass_fields__})
    if "maturation_period" in merge:
        policy.maturation_seconds = period(merge["maturation_period"])
    keep = config.get("retention", {}).get("period")
    return IndexConfig(
        check_name(config["index_id"]), mapping, tuple(doc.get("tag_fields", ())), doc.get("partition_key"), int(doc.get("max_num_partitions", 200)),
        int(indexing.get("split_num_docs_target", 10_000_000)), int(indexing.get("commit_timeout_secs", 60)), policy, period(keep) if keep else None,
        {s["source_id"]: s for s in config.get("sources", ())}, config,
    )


def from_template(name: str, templates: list[dict[str, Any]]) -> dict[str, Any] | None:
    """The configuration that the fitting template of the highest priority gives; ties go to the first by id."""
    fit = [t for t in templates if any(fnmatchcase(name, p) for p in t["index_id_patterns"])]
    if not fit:
        return None
    best = min(fit, key=lambda t: (-int(t.get("priority", 0)), t["template_id"]))
    return {k: v for k, v in best.items() if k not in ("template_id", "index_id_patterns", "priority", "description")} | {"index_id": name}

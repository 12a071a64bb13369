"""Rule libraries: one JSON or YAML document per rule in a folder tree, and writing one."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from barkeel.sources.store import gated_rules

SCHEMA = "name string, status string, reviewer string, reviewed_at string, source_verified boolean, facts map<string,string>, path string"
_TOP = ("name", "status", "reviewer", "reviewed_at", "source_verified")


def read_document(path: Path) -> Mapping[str, Any]:
    """One document; YAML needs its library."""
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    if not isinstance(raw, Mapping) or not str(raw.get("name", "")).strip():
        raise ValueError(f"not a rule: {path}")
    return raw


def load_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All rules under a folder, in path order, through the approval gate; a small dimension table."""
    paths = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".json", ".yaml", ".yml"))
    rows = []
    for p in paths:
        raw = read_document(p)
        facts = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str) for k, v in raw.items() if k not in _TOP}
        status = raw.get("status") or "candidate"
        rows.append((raw["name"], status, raw.get("reviewer"), None if raw.get("reviewed_at") is None else str(raw["reviewed_at"]), raw.get("source_verified"), facts, str(p)))
    return gated_rules(spark.createDataFrame(rows, SCHEMA))


def write_rule(rule: Mapping[str, Any], path: str) -> None:
    """Write one rule as JSON; readers see the old or the new document, never a part."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, part = tempfile.mkstemp(dir=target.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(dict(rule), f, ensure_ascii=False, sort_keys=True)
    os.replace(part, target)

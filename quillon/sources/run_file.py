"""Run files: 'key = value' lines to the first blank line, then lines '<id> <keywords>'."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

# Codes of the algorithms in run files.
ALGORITHMS = {1: "sparse", 2: "global_pipeline", 5: "queue_pipeline", 7: "two_level_bound", 10: "tree_pipeline"}


@dataclass(frozen=True)
class Config:
    k: int = 10
    dataset: str = "sales"
    offline_networks: bool = False
    algorithms: tuple[str, ...] = ("sparse",)
    alpha: float = 2.0
    max_size: int = 4
    connection: dict[str, str] = field(default_factory=dict)


def read_config(lines: Iterable[str]) -> Config:
    """Unknown keys are errors. SERVER, USERNAME, PASSWORD and RDMS go to connection."""
    found = Config()
    for line in lines:
        if not line.strip():
            break
        key, eq, value = line.partition("=")
        key, value = key.strip().upper(), value.strip()
        if not eq:
            raise ValueError(f"not 'key = value': {line!r}")
        if key == "K":
            found = replace(found, k=int(value))
        elif key == "DATASET":
            found = replace(found, dataset=value)
        elif key == "OFFLINE_CN_SEARCH":
            found = replace(found, offline_networks=value.lower() in ("1", "true", "yes", "on"))
        elif key == "ALGS":
            found = replace(found, algorithms=tuple(ALGORITHMS[int(c)] for c in value.replace(",", " ").split()))
        elif key == "ALPHA":
            found = replace(found, alpha=float(value))
        elif key == "MAXCN":
            found = replace(found, max_size=int(value))
        elif key in ("SERVER", "USERNAME", "PASSWORD", "RDMS"):
            found = replace(found, connection={**found.connection, key.lower(): value})
        else:
            raise ValueError(f"unknown key: {key}")
    return found


def read_queries(lines: Iterable[str]) -> list[tuple[str, str]]:
    found, body = [], False
    for line in lines:
        if not line.strip():
            body = True
        elif body:
            name, _, words = line.strip().partition(" ")
            found.append((name, words.strip()))
    return found

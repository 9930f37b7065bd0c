"""Settings with defaults, read from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from ringspark.schema import RANDOM_GRAPH

PREFIX = "RINGSPARK_"


@dataclass(frozen=True)
class Config:
    """What random graphs, training and searches use unless they are told otherwise."""

    min_nodes: int = RANDOM_GRAPH["min_nodes"]
    max_nodes: int = RANDOM_GRAPH["max_nodes"]
    min_prob: float = RANDOM_GRAPH["min_prob"]
    max_prob: float = RANDOM_GRAPH["max_prob"]
    epochs: int = 5000
    hidden: int = 64
    learning_rate: float = 0.005
    evaluate_every: int = 20
    debug: bool = False


def parsed(kind: str, text: str):
    if kind == "bool":
        return text.strip().lower() in ("1", "true", "yes")
    return int(text) if kind == "int" else float(text)


def read(env: Mapping[str, str] | None = None) -> Config:
    """The settings of variables like RINGSPARK_MIN_NODES; a value that is no number is an error."""
    env = os.environ if env is None else env
    own = {f.name: parsed(str(f.type), env[key]) for f in fields(Config) if (key := PREFIX + f.name.upper()) in env}
    return Config(**own)

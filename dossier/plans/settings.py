"""Settings of ingestion, expansion and retrieval: tables of names, defaults and ranges, checked when a value is made."""

from __future__ import annotations

import math
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any, NamedTuple

# Relation kinds, whether a text states them or they are inferred, and their weight in an expansion (None: not followed).
STATED, INFERRED = "stated", "inferred"
RELATIONS: dict[str, tuple[str, float | None]] = {
    "CITES": (STATED, 0.35), "AMENDS": (STATED, 0.9), "ADDS_TO": (STATED, 0.9), "REPEALS": (STATED, 0.9), "REPLACES": (STATED, 0.9),
    "DETAILS": (STATED, 0.9), "IMPLEMENTS": (STATED, 0.8), "GUIDES_IMPLEMENTATION_OF": (STATED, 0.8), "SPECIFIES": (INFERRED, 0.9),
    "SETS_CONDITION_FOR": (INFERRED, 1.0), "EXCEPTION_TO": (INFERRED, 1.0), "PENALTY_FOR": (INFERRED, 1.0), "DEFINES": (INFERRED, None), "REGULATES": (INFERRED, None),
}
# Modes of an expansion, the kinds each follows, and the modes that go to siblings too.
MODES = {"M0": (), "M1": (), "M2": (STATED,), "M3": (INFERRED,), "M4": (STATED, INFERRED)}
STRUCTURAL_MODES, STRUCTURAL_WEIGHT = ("M1", "M4"), 0.15


def kinds_of(*families: str) -> list[str]:
    return sorted(kind for kind, (family, _) in RELATIONS.items() if family in families)


EXPLICIT, SEMANTIC = tuple(kinds_of(STATED)), tuple(kinds_of(INFERRED))
WEIGHTS = {"STRUCTURAL": STRUCTURAL_WEIGHT} | {kind: weight for kind, (_, weight) in RELATIONS.items() if weight is not None}


class Setting(NamedTuple):
    """A default, a test of a value (given all values), and what the test asks for."""

    default: Any
    good: Callable[[Any, dict[str, Any]], bool]
    asks: str


def _between(default: float, low: float, high: float = math.inf) -> Setting:
    return Setting(default, lambda x, _: math.isfinite(x) and low <= x <= high, f"lie in [{low}, {high}]")


def _one_of(default: str, *values: str) -> Setting:
    return Setting(default, lambda x, _: x in values, f"be one of {', '.join(values)}")


class Checked:
    """A value with the settings of a table; each is an attribute and can't be changed."""

    TABLE: dict[str, Setting] = {}

    def __init__(self, **given: Any):
        values = {name: setting.default for name, setting in self.TABLE.items()} | given
        if unknown := sorted(given.keys() - self.TABLE.keys()):
            raise TypeError(f"unknown settings: {', '.join(unknown)}")
        for name, setting in self.TABLE.items():
            if not setting.good(values[name], values):
                raise ValueError(f"{name} must {setting.asks}")
        self.__dict__.update(values)

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("settings can't be changed")

    def __eq__(self, other: object) -> bool:
        return type(other) is type(self) and vars(other) == vars(self)

    __hash__ = None

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"


class Expansion(Checked):
    """Bounds of one graph expansion."""

    TABLE = {
        "confidence": _between(0.8, 0, 1), "decay": _between(0.65, 0, 1), "graph_weight": _between(0.15, 0, 1),
        "depth": _between(2, 1, 4), "seed_limit": _between(5, 1), "per_node_limit": _between(12, 1), "candidate_budget": _between(60, 1),
        "hybrid_pool": Setting(None, lambda x, all_: x is None or x >= all_["candidate_budget"], "be at least candidate_budget"),
        "context_chars": Setting(None, lambda x, _: x is None or x > 0, "be positive"),
        "weights": Setting(WEIGHTS, lambda x, _: all(math.isfinite(w) and 0 <= w <= 1 for w in x.values()), "lie in [0, 1]"),
        "mode": _one_of("M4", *MODES), "scoring": _one_of("legacy", "legacy", "shared", "shared_path"),
    }

    @property
    def kinds(self) -> list[str]:
        return kinds_of(*MODES[self.mode])

    @property
    def structural(self) -> bool:
        return self.mode in STRUCTURAL_MODES


class Settings(Checked):
    """Sizes and limits of the pipelines, and the models they name; ``read`` takes them from a file and the environment."""

    TABLE = {
        "chunk_chars": _between(1800, 1), "chunk_overlap": Setting(250, lambda x, all_: 0 <= x < all_["chunk_chars"], "be within chunk_chars"),
        "top_k": _between(10, 1), "expansion_limit": _between(12, 1), "context_chars": _between(18_000, 1), "chunks_per_document": _between(2, 1),
        "relation_candidates": _between(20, 1), "relation_representatives": _between(3, 1), "relation_limit": _between(20, 1), "relation_features": _between(50_000, 1),
        "embedding_model": Setting("stub", lambda x, _: bool(x), "be named"), "store": Setting("", lambda x, _: isinstance(x, str), "be a folder"),
    }

    @classmethod
    def read(cls, path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
        """NAME=value lines of ``path``; the environment's values win."""
        found: dict[str, str] = {}
        if path and Path(path).exists():
            for line in Path(path).read_text(encoding="utf-8").splitlines():
                name, mark, value = line.partition("=")
                if mark and not name.lstrip().startswith("#"):
                    found[name.strip()] = value.strip().strip("\"'")
        found |= os.environ if environment is None else environment
        given = {name: found[name.upper()] for name in cls.TABLE if name.upper() in found}
        return cls(**{name: type(cls.TABLE[name].default)(value) for name, value in given.items()})

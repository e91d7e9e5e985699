"""Settings from the environment, checked when they are read; and the limits of a question."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from paperloom import config as C

PREFIX = "PAPERLOOM_"
#: How many results may be asked for.
TOP_K = range(1, 21)


def flag(raw: str | None, default: bool) -> bool:
    """1, true, yes and on in any case are true, nothing or blank is the default, anything else false."""
    return default if raw is None or raw == "" else raw.strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    cross_stage: bool = True
    second_opinion: bool = True
    source_filter: bool = True
    rerank_cut: int = C.RERANK_CUT
    max_file_bytes: int = C.MAX_FILE_BYTES

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        given = {}
        for name, default in vars(cls()).items():
            raw = env.get(PREFIX + name.upper())
            if isinstance(default, bool):
                given[name] = flag(raw, default)
            elif raw not in (None, ""):
                if not raw.strip().isdigit() or int(raw) < 1:
                    raise ValueError(f"{PREFIX}{name.upper()} must be a whole number from 1, not {raw!r}")
                given[name] = int(raw)
        return cls(**given)


@dataclass(frozen=True)
class Question:
    text: str
    top_k: int = 10
    collections: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.text:
            raise ValueError("a question must have a text")
        if self.top_k not in TOP_K:
            raise ValueError(f"top_k must be from {TOP_K[0]} to {TOP_K[-1]}, not {self.top_k}")

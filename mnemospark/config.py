"""Options of a memory table."""

from __future__ import annotations

from dataclasses import dataclass


def _positive(name: str, value, kind=int) -> None:
    if isinstance(value, bool) or not isinstance(value, kind) or value <= 0:
        raise ValueError(f"{name} must be a positive {'number' if kind is not int else 'integer'}, not {value!r}")


@dataclass(frozen=True)
class MemoryConfig:
    """dim: length of latent vectors; action_dim: length of action vectors, None if rows have none;
    k: rows that a recall returns; latency_budget_ms: declared, and reported next to measured latencies."""

    dim: int
    action_dim: int | None = None
    k: int = 8
    latency_budget_ms: float = 2.0

    def __post_init__(self) -> None:
        _positive("dim", self.dim)
        if self.action_dim is not None:
            _positive("action_dim", self.action_dim)
        _positive("k", self.k)
        _positive("latency_budget_ms", self.latency_budget_ms, (int, float))

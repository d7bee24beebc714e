"""A synthetic world model and trajectories drawn from it, generated on the executors.

Noise comes from a generator keyed by (seed, episode, step), so results don't depend on the order or the
place in which episodes are made, and a recomputed task gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class WorldModel(Protocol):
    """What an operator needs of a model; NumPy arrays in and out."""

    dim: int
    action_dim: int | None

    def encode(self, observation: np.ndarray) -> np.ndarray: ...
    def step(self, z: np.ndarray, action: np.ndarray | None, key: tuple[int, ...] = ()) -> np.ndarray: ...
    def reset(self, key: tuple[int, ...] = ()) -> np.ndarray: ...
    def sample_action(self, key: tuple[int, ...] = ()) -> np.ndarray | None: ...


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v)


@dataclass(frozen=True)
class SyntheticWorld:
    """Linear dynamics on the unit sphere: normalise(A z + B a + noise)."""

    dim: int
    action_dim: int | None = None
    seed: int = 0
    noise: float = 0.05

    def _rng(self, *key: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, *key])

    def _matrix(self, which: int, n: int) -> np.ndarray:
        return self._rng(which).standard_normal((self.dim, n)) / np.sqrt(n)

    def encode(self, observation: np.ndarray) -> np.ndarray:
        return _unit(np.asarray(observation, float))

    def reset(self, key: tuple[int, ...] = ()) -> np.ndarray:
        return self._rng(3, *key).standard_normal(self.dim)

    def sample_action(self, key: tuple[int, ...] = ()) -> np.ndarray | None:
        return None if self.action_dim is None else self._rng(4, *key).standard_normal(self.action_dim)

    def step(self, z: np.ndarray, action: np.ndarray | None, key: tuple[int, ...] = ()) -> np.ndarray:
        if (action is None) != (self.action_dim is None):
            raise ValueError("an action is needed exactly if the model has actions")
        out = self._matrix(1, self.dim) @ z + self.noise * self._rng(5, *key).standard_normal(self.dim)
        return _unit(out if action is None else out + self._matrix(2, self.action_dim) @ action)


STEP_SCHEMA = "episode_id long, seq_no long, z array<double>, action array<double>, z_next array<double>, pred_err double"


def trajectory(model: WorldModel, length: int, episode_id: int) -> Iterator[tuple]:
    """The steps of one episode; pred_err is the distance between a latent and the next."""
    z = model.encode(model.reset((episode_id,)))
    for s in range(length):
        action = model.sample_action((episode_id, s))
        nxt = model.step(z, action, (episode_id, s))
        yield episode_id, s, z, action, nxt, float(np.linalg.norm(nxt - z))
        z = nxt


def trajectories(spark: SparkSession, model: WorldModel, n_episodes: int, length: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for e in f["id"]:
                yield pd.DataFrame(trajectory(model, length, int(e)), columns=["episode_id", "seq_no", "z", "action", "z_next", "pred_err"])

    return spark.range(n_episodes).mapInPandas(run, STEP_SCHEMA)


def model_steps(rows: DataFrame, model: WorldModel, out: str = "base") -> DataFrame:
    """rows with the model's own prediction of the next latent from (z, action)."""

    @F.pandas_udf("array<double>")
    def predicted(part: pd.DataFrame) -> pd.Series:
        act = lambda a: None if a is None else np.asarray(a, float)
        return pd.Series([model.step(np.asarray(z, float), act(a), (int(e), int(s))) for z, a, e, s in zip(part["z"], part["action"], part["episode_id"], part["seq_no"], strict=True)])

    return rows.withColumn(out, predicted(F.struct("z", "action", "episode_id", "seq_no")))

"""One rollout step as one lazy job: generate -> score -> combine -> (log).

The reference runs this per batch in a loop; here it is a single DataFrame
plan over all queries: generation runs in Arrow-batched Python workers
(``generate``), scoring and reward combination are column expressions fused
after it, and logging is an append to the run-partitioned log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from prefline.config import RewardConfig
from prefline.operators.generate import EchoGenerator, generate
from prefline.operators.rewards import compute_reward
from prefline.sources.sinks import append_log


def rollout_rewards(queries: DataFrame, detector, pair_scorer=None, cfg: RewardConfig = RewardConfig(),
                    generator_factory=EchoGenerator, key: str = "conv_id") -> DataFrame:
    """(key, query, response, ref_response, reward, ref_reward) for every query row."""
    answers = generate(queries, generator_factory, key=key)
    scored = compute_reward(answers, detector, pair_scorer, cfg)
    return scored.select(key, "query", "response", "ref_response", "reward", "ref_reward")


def log_rollout(rewards: DataFrame, path: str, run_id: str, key: str = "conv_id") -> None:
    """The logged columns of a rollout step (``ref_reward`` logged as ``ref_rewards``)."""
    append_log(rewards.withColumnRenamed("ref_reward", "ref_rewards"), path, run_id, key)

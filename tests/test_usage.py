"""The README usage example, executed."""

from given_tables import SF_SMALL


def test_readme_usage(spark):
    root = SF_SMALL
    # --- begin usage ---
    from pyspark.sql import functions as F

    from prefline.config import DatasetConfig, RewardConfig, SplitConfig
    from prefline.operators.datasets import build_query_dataset
    from prefline.operators.pairs import preference_pairs
    from prefline.operators.preference import process
    from prefline.operators.rollout import log_rollout, rollout_rewards
    from prefline.operators.scorers import OverlapPairScorer, WordStatDetector
    from prefline.operators.split import train_eval
    from prefline.operators.tokens import build_vocab
    from prefline.operators.trials import trial_losses, trial_table
    from prefline.session import checkpoint_root
    from prefline.sources.sinks import new_run_id
    from prefline.sources.tables import Catalog

    cat = Catalog(spark, root)                       # name -> table (register your own paths)
    conversations = cat.load("conversations")

    # query dataset: render, tokenise, filter by length, pad (build_dataset)
    vocab = build_vocab(cat.load("documents"))
    queries = build_query_dataset(conversations, vocab, DatasetConfig(max_length=125))

    # preference dataset + exact 80/20 split (DPO preprocessing)
    pairs = preference_pairs(conversations)
    rendered = process(pairs, "google/gemma-1.1-2b-it", sys_prompt=True)
    train, evaluation = train_eval(rendered, "conv_id", SplitConfig(fraction=0.8, seed=42))

    # one rollout step: generate, score, combine, log (PPO loop body without the update)
    rewards = rollout_rewards(queries.select("conv_id", "query"), WordStatDetector(), OverlapPairScorer(),
                              RewardConfig(hf_model_weight=0.5))
    log_rollout(rewards, f"{checkpoint_root(spark)}/rollout_log", new_run_id())

    # sweep: all trials evaluated in one pass over logged scores
    margins = pairs.select("conv_id", (F.length("chosen") - F.length("rejected")).cast("double").alias("x"))
    losses = trial_losses(margins, trial_table(spark, 10))
    # --- end usage ---
    assert queries.count() > 0 and train.count() + evaluation.count() == pairs.count()
    assert rewards.count() == queries.count() and losses.count() == 10

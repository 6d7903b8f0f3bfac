"""The query catalogue: one ``(spark, sf_dir) -> DataFrame`` per operator group.

Keys and output columns match ``prefline.plans.oracle.sql_catalog``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefline.config import (CHAT_TEMPLATES, DATASET_MAX_TOKENS, MIN_REVIEW_CHARS, QUERY_MAX_TOKENS, QUERY_SYSTEM_PROMPT, SCORER_MAX_TOKENS, DatasetConfig,
                             RewardConfig, SplitConfig, TokenConfig, SWEEP_COUNT)
from prefline.functions import scores as S
from prefline.functions import templates as TM
from prefline.functions.chat_template import compile_template
from prefline.functions.text import token_count, word_count, words
from prefline.operators import bayes_scorer, subword
from prefline.operators import rewards as R
from prefline.operators import preference as P
from prefline.operators import budget  # noqa: F401  registers its scorer
from prefline.operators.batches import length_batches, pad_batches
from prefline.operators.generate import EchoGenerator, generate
from prefline.operators.ml_scorer import LinearTextScorer
from prefline.operators.evaluate import evaluate_once
from prefline.operators.datasets import build_prefix_dataset, build_query_dataset
from prefline.operators.pairs import first_queries, pair_keys, preference_pairs, rollout
from prefline.operators.quarantine import quarantine
from prefline.operators.rollout import rollout_rewards
from prefline.operators.scorers import OverlapPairScorer, RawScoreDetector, WordStatDetector, build_scorer, human_logit
from prefline.operators.split import split_audit, split_parts
from prefline.operators.tokens import build_vocab, encode_join
from prefline.operators.trials import best_trials, trial_losses, trial_table, with_schedule
from prefline.sources.adapters import adapt_queries, nested_reason
from prefline.session import checkpoint_root, scratch_path
from prefline.sources.sinks import LOG_COLUMNS, append_log, new_run_id, read_log, read_row_tensors, write_row_tensors
from prefline.sources.tables import read_table, spread, table_path
from prefline.streaming.score_stream import score_new_turns
from prefline.streaming.step_log import log_scored_turns

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_table(spark, root, name)


def rollout_frame(spark: SparkSession, root: str) -> DataFrame:
    return rollout(preference_pairs(_t(spark, root, "conversations")))


def scored_rollout(spark: SparkSession, root: str) -> DataFrame:
    """Rollout with human (label-array detector) and helpfulness (pair scorer) scores."""
    df = rollout_frame(spark, root)
    df = R.human_scores(df, WordStatDetector())
    return R.pair_scores(df, OverlapPairScorer())


def pairs_frame(spark: SparkSession, root: str) -> DataFrame:
    return preference_pairs(_t(spark, root, "conversations"))


def keys_frame(spark: SparkSession, root: str) -> DataFrame:
    return pair_keys(_t(spark, root, "conversations"))


def vocabulary(spark: SparkSession, root: str, cfg: TokenConfig = TokenConfig()) -> DataFrame:
    return build_vocab(_t(spark, root, "documents"), "text", cfg)


def pair_margins(spark: SparkSession, root: str) -> DataFrame:
    """x = human_logit(chosen) - human_logit(rejected) per pair (stands in for log-ratios)."""
    pairs = pairs_frame(spark, root)
    return evaluate_once(pairs, x=human_logit("chosen") - human_logit("rejected")).select("conv_id", "x")


SCALE_RANGES = (("logit_to_unit", -6.0, 2.0, 0.0, 1.0),
                ("unit_to_cap", 0.0, 1.0, -4.0, 4.0),
                ("reversed", -6.0, 2.0, 1.0, -1.0))


def q01_project_rename(spark: SparkSession, root: str) -> DataFrame:
    docs = _t(spark, root, "documents").withColumnRenamed("text", "review")
    return docs.select("doc_id", "review")


def q02_first_query(spark: SparkSession, root: str) -> DataFrame:
    return adapt_queries(_t(spark, root, "conversations")).select("conv_id", "query")


def q03_min_chars(spark: SparkSession, root: str) -> DataFrame:
    # n_chars equals char_length(text) on these tables and pushes down to the scan;
    # char_length(text) is the general form (F2) used when n_chars is absent.
    docs = _t(spark, root, "documents")
    return docs.where(F.col("n_chars") > MIN_REVIEW_CHARS).select("doc_id", "n_chars")


def q04_prompt(spark: SparkSession, root: str) -> DataFrame:
    qs = first_queries(_t(spark, root, "conversations"))
    return qs.select("conv_id", TM.user_prompt(F.col("query")).alias("prompt"))


def q05_prompt_system(spark: SparkSession, root: str) -> DataFrame:
    qs = first_queries(_t(spark, root, "conversations"))
    return qs.select("conv_id", TM.user_prompt(F.col("query"), QUERY_SYSTEM_PROMPT).alias("prompt"))


def q06_encode_filter(spark: SparkSession, root: str) -> DataFrame:
    # F1 on the token count (the count the encoder would produce); the ids are
    # not part of the output, so no array is built and nothing is encoded.
    docs = spread(_t(spark, root, "documents").select("doc_id", "text"))
    docs = evaluate_once(docs, n_tokens=token_count("text").cast("long"))
    return docs.where(F.col("n_tokens") <= DATASET_MAX_TOKENS).select("doc_id", "n_tokens")


def _joined_arrays(ds: DataFrame) -> DataFrame:
    return ds.select("conv_id", F.array_join("input_ids", ",").alias("ids"),
                     F.array_join("attention_mask", ",").alias("mask"), "n_tokens")


def q07_pad_mask(spark: SparkSession, root: str) -> DataFrame:
    cfg = DatasetConfig(max_length=QUERY_MAX_TOKENS, padding=True, padding_side="left")
    return _joined_arrays(build_query_dataset(_t(spark, root, "conversations"), vocabulary(spark, root), cfg, template=False))


def q08_random_prefix(spark: SparkSession, root: str) -> DataFrame:
    ds = build_prefix_dataset(_t(spark, root, "documents").select("doc_id", "text"), vocabulary(spark, root))
    return ds.select("doc_id", "k", "query")


def q09_pref_mistral(spark: SparkSession, root: str) -> DataFrame:
    out = P.process(pairs_frame(spark, root), "mistralai/Mistral-7B-Instruct-v0.2")
    return out.select("conv_id", "prompt", "chosen", "rejected")


def q10_pref_gemma(spark: SparkSession, root: str) -> DataFrame:
    out = P.process(pairs_frame(spark, root), "google/gemma-1.1-2b-it", sys_prompt=True)
    return out.select("conv_id", "prompt", "chosen", "rejected")


def q11_pref_default(spark: SparkSession, root: str) -> DataFrame:
    out = P.process(pairs_frame(spark, root), "microsoft/Phi-3-mini-4k-instruct")
    return out.select("conv_id", "prompt", "chosen", "rejected")


def q12_pref_messages(spark: SparkSession, root: str) -> DataFrame:
    rows = P.message_preference_rows(_t(spark, root, "conversations"))
    out = P.process(rows, "microsoft/Phi-3-mini-4k-instruct")
    return out.select("conv_id", "prompt", "chosen", "rejected")


def q13_split(spark: SparkSession, root: str) -> DataFrame:
    return split_parts(keys_frame(spark, root), "conv_id",
                       SplitConfig(fraction=0.8, seed=42)).select("conv_id", "part")


def q14_split_independent(spark: SparkSession, root: str) -> DataFrame:
    cfg = SplitConfig(fraction=0.8, seed=42, mode="independent", eval_seed=43)
    return split_parts(keys_frame(spark, root), "conv_id", cfg).select("conv_id", "part")


def q15_scale(spark: SparkSession, root: str) -> DataFrame:
    df = WordStatDetector().score_frame(rollout_frame(spark, root), "response", "__out")
    raw = S.label_score("__out")
    rows = F.array(*[F.struct(F.lit(name).alias("rng"), S.scale(raw, *b).alias("scaled"))
                     for name, *b in SCALE_RANGES])
    return df.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.rng", "r.scaled")


def q16_capped(spark: SparkSession, root: str) -> DataFrame:
    df = R.human_scores(rollout_frame(spark, root), RawScoreDetector(), "binoculars")
    return df.select("conv_id", "human", "ref_human")


def q17_human_label(spark: SparkSession, root: str) -> DataFrame:
    df = R.human_scores(rollout_frame(spark, root), WordStatDetector())
    return df.select("conv_id", "human", "ref_human")


def q18_pair_score(spark: SparkSession, root: str) -> DataFrame:
    df = R.pair_scores(rollout_frame(spark, root), OverlapPairScorer())
    return df.select("conv_id", "helpful", "ref_helpful")


def q19_reward_min(spark: SparkSession, root: str) -> DataFrame:
    df = R.combine(scored_rollout(spark, root), RewardConfig(use_min=True))
    return df.select("conv_id", "reward", "ref_reward")


def q20_reward_weighted(spark: SparkSession, root: str) -> DataFrame:
    df = R.combine(scored_rollout(spark, root), RewardConfig(hf_model_weight=0.5))
    return df.select("conv_id", "reward", "ref_reward",
                     (F.col("reward") - F.col("ref_reward")).alias("margin"))


def q21_reward_single(spark: SparkSession, root: str) -> DataFrame:
    ro = rollout_frame(spark, root)
    human = R.compute_reward(ro, WordStatDetector(), None, RewardConfig()) \
        .select("conv_id", F.lit("human_only").alias("mode"), "reward", "ref_reward")
    normal = R.compute_reward(ro, OverlapPairScorer(), None, RewardConfig(normal_training=True)) \
        .select("conv_id", F.lit("normal_training").alias("mode"), "reward", "ref_reward")
    return human.unionByName(normal)


def q22_reward_log(spark: SparkSession, root: str) -> DataFrame:
    df = R.combine(scored_rollout(spark, root), RewardConfig(hf_model_weight=0.5))
    df = df.withColumnRenamed("ref_reward", "ref_rewards")
    path = f"{checkpoint_root(spark)}/rollout_log"
    run_id = new_run_id()
    logged = df.select("conv_id", *LOG_COLUMNS)
    append_log(logged, path, run_id)
    return read_log(spark, path, run_id, logged.schema).select("conv_id", *LOG_COLUMNS)


def q23_word_count(spark: SparkSession, root: str) -> DataFrame:
    docs = spread(_t(spark, root, "documents").select("doc_id", "text"))
    return docs.select("doc_id", word_count("text").cast("long").alias("n_words"))


def q24_net_length(spark: SparkSession, root: str) -> DataFrame:
    df = rollout_frame(spark, root)
    return df.select("conv_id", (F.size(words("response")) - F.size(words("query"))).cast("long").alias("net_words"))


def q25_trials(spark: SparkSession, root: str) -> DataFrame:
    # The sweep trains on the whole preference set (split 1): every trial's
    # schedule follows the number of pairs the data yields.
    n_train = keys_frame(spark, root).select(F.count("*")).scalar()
    return with_schedule(trial_table(spark, SWEEP_COUNT), n_train)


def q26_trial_loss(spark: SparkSession, root: str) -> DataFrame:
    return trial_losses(pair_margins(spark, root), trial_table(spark, SWEEP_COUNT))


def q27_best_trials(spark: SparkSession, root: str) -> DataFrame:
    return best_trials(q26_trial_loss(spark, root), 3).select("trial", "loss")


def q28_split_leak(spark: SparkSession, root: str) -> DataFrame:
    return split_audit(keys_frame(spark, root), "conv_id", 0.8, 42, 43)


def q29_quarantine(spark: SparkSession, root: str) -> DataFrame:
    _, bad = quarantine(_t(spark, root, "documents"), _t(spark, root, "labels"))
    return bad.select("doc_id", "reason")


def q30_vocab(spark: SparkSession, root: str) -> DataFrame:
    return vocabulary(spark, root)


def q31_generate(spark: SparkSession, root: str) -> DataFrame:
    qs = first_queries(_t(spark, root, "conversations"))
    return generate(qs, EchoGenerator).select("conv_id", "response", "ref_response")


def q32_ml_scorer(spark: SparkSession, root: str) -> DataFrame:
    docs = _t(spark, root, "documents").select("doc_id", "text")
    labelled = docs.join(_t(spark, root, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    scorer = LinearTextScorer().fit(labelled, "text", "label")
    return scorer.probability(docs, "text", "score").select("doc_id", "score")


def q33_stream_score(spark: SparkSession, root: str) -> DataFrame:
    return score_new_turns(spark, table_path(root, "conversations")).select("conv_id", "turn", "score")


def q34_rollout_reward(spark: SparkSession, root: str) -> DataFrame:
    """R11 end to end: first user turns -> generated answers -> rewards."""
    qs = first_queries(_t(spark, root, "conversations"))
    out = rollout_rewards(qs, WordStatDetector(), OverlapPairScorer(), RewardConfig(hf_model_weight=0.5))
    return out.select("conv_id", "response", "ref_response", "reward", "ref_reward")


def q35_encode_documents(spark: SparkSession, root: str) -> DataFrame:
    """T6 on whole documents with the uncapped vocabulary."""
    docs = spread(_t(spark, root, "documents").select("doc_id", "text")).select("doc_id", words("text").alias("w"))
    out = encode_join(docs, "doc_id", "w", vocabulary(spark, root))
    return out.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"),
                      F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids_md5"))


def q36_prompt_dataset(spark: SparkSession, root: str) -> DataFrame:
    """Rendered prompt -> ids -> limit -> padded ids and mask."""
    cfg = DatasetConfig(max_length=QUERY_MAX_TOKENS)
    return _joined_arrays(build_query_dataset(_t(spark, root, "conversations"), vocabulary(spark, root), cfg))


def q37_prompt_dataset_system(spark: SparkSession, root: str) -> DataFrame:
    """The same with the system message first."""
    cfg = DatasetConfig(max_length=QUERY_MAX_TOKENS, sys_prompt=True)
    return _joined_arrays(build_query_dataset(_t(spark, root, "conversations"), vocabulary(spark, root), cfg))


BOS, BATCH_SIZE, STEP_ROWS, TENSOR_SHARD = "<bos>", 16, 4, 4096


def q38_chat_templates(spark: SparkSession, root: str) -> DataFrame:
    """Each template, compiled from its text, over all messages of a conversation."""
    messages = P.conversation_messages(_t(spark, root, "conversations"))
    rows = [F.struct(F.lit(name).alias("template"), compile_template(text, bos_token=BOS, add_generation_prompt=True)(F.col("messages")).alias("rendered"))
            for name, text in CHAT_TEMPLATES.items()]
    return messages.select("conv_id", F.inline(F.array(*rows)))


def q39_bayes_scorer(spark: SparkSession, root: str) -> DataFrame:
    """Trained on the labelled documents that are not held out, scoring all documents."""
    docs = _t(spark, root, "documents").select("doc_id", "text")
    labels = _t(spark, root, "labels").select("doc_id", F.col("quality").alias("label")).where(~bayes_scorer.held_out("doc_id"))
    model = bayes_scorer.train(docs.join(labels, "doc_id"))
    out = bayes_scorer.score(docs, model, "doc_id")
    return out.select("doc_id", bayes_scorer.held_out("doc_id").alias("held_out"), "score", (F.col("score") > 0).cast("int").alias("predicted"))


def q40_length_batches(spark: SparkSession, root: str) -> DataFrame:
    """Rendered prompts dealt into batches by length, padded to each batch's longest."""
    cfg = DatasetConfig(max_length=QUERY_MAX_TOKENS, padding=False)
    ds = build_query_dataset(_t(spark, root, "conversations"), vocabulary(spark, root), cfg)
    batched = pad_batches(length_batches(ds, "conv_id", "input_ids", BATCH_SIZE), "input_ids")
    return _joined_arrays(batched).join(batched.select("conv_id", "batch", "batch_length"), "conv_id")


def q41_step_log(spark: SparkSession, root: str) -> DataFrame:
    """Scored turns as a step-numbered stream; step 1 and each 10th are logged."""
    return log_scored_turns(spark, table_path(root, "conversations"), STEP_ROWS)


def q42_nested_queries(spark: SparkSession, root: str) -> DataFrame:
    """The nested source form, with the reason where a row has no query."""
    turn = F.when(F.col("role") == "user", F.struct("turn", F.col("text").alias("input")))
    rows = _t(spark, root, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    nested = rows.select("conv_id", F.lit("turns").alias("source"), F.transform("turns", lambda t: F.struct(t["input"].alias("input"))).alias("conversation"))
    return adapt_queries(nested.withColumn("reason", nested_reason()))


def q43_split_repeated(spark: SparkSession, root: str) -> DataFrame:
    """L2, L3 on a key that stands on many rows: the part sizes are exact all the same."""
    parts = split_parts(_t(spark, root, "documents").select("lang"), "lang", SplitConfig(fraction=0.55, seed=42))
    return parts.groupBy("lang", "part").agg(F.count("*").alias("n"))


def _subword(spark: SparkSession) -> subword.SubwordTokenizer:
    import public_tokenizers

    return subword.SubwordTokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))


def q44_subword_prompts(spark: SparkSession, root: str) -> DataFrame:
    """P5, P9, T6, T8 with a public vocabulary: template -> ids -> limit -> batches."""
    cfg = DatasetConfig(max_length=QUERY_MAX_TOKENS, sys_prompt=True, padding="longest")
    template = compile_template(CHAT_TEMPLATES["im_marks"], add_generation_prompt=True)
    ds = subword.build_query_dataset(_t(spark, root, "conversations"), _subword(spark), cfg, template, batch_size=BATCH_SIZE)
    return ds.select("conv_id", "batch", "batch_length", "n_tokens", F.array_join("input_ids", ",").alias("ids"))


def q45_subword_prefix(spark: SparkSession, root: str) -> DataFrame:
    """P10, T7, T9 with a public vocabulary."""
    ds = subword.build_prefix_dataset(_t(spark, root, "documents").select("doc_id", "text"), _subword(spark))
    return ds.select("doc_id", "k", "query")


def q46_budget_scores(spark: SparkSession, root: str) -> DataFrame:
    """Documents through a batch scorer found by name, whole and cut to the
    scorer's limit, in batches bounded by tokens."""
    docs = _t(spark, root, "documents").select("doc_id", "text")
    runs = []
    for limit in (None, SCORER_MAX_TOKENS):
        scorer = build_scorer("text-classification:wordstat-batch")
        scorer.max_tokens = limit
        scored = scorer.score_frame(docs, "text", "out").withColumn("score", S.label_score("out"))
        runs.append(scored.select("doc_id", F.lit(limit).cast("int").alias("max_tokens"), F.nanvl("score", F.lit(None).cast("double")).alias("score")))
    return runs[0].unionByName(runs[1])


def q47_tensor_rows(spark: SparkSession, root: str) -> DataFrame:
    """The prompt dataset, padded with the end-of-sequence id, stored as arrays of
    one length with an index of rows, and read back in two ranges of rows."""
    cfg = DatasetConfig(max_length=QUERY_MAX_TOKENS, tokens=TokenConfig(pad_id=None))
    vocab = vocabulary(spark, root, cfg.tokens)
    ds = build_query_dataset(_t(spark, root, "conversations"), vocab, cfg).select("conv_id", "input_ids", "attention_mask")
    path = scratch_path(spark, "row-tensors")
    write_row_tensors(ds, path, ["conv_id"], ["input_ids", "attention_mask"], cfg.max_length, TENSOR_SHARD)
    rows = read_row_tensors(spark, path, 0, TENSOR_SHARD, ds.schema).unionByName(read_row_tensors(spark, path, TENSOR_SHARD, None, ds.schema))
    items = F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "item")
    return rows.select("row", "conv_id", items).select("row", "conv_id", "pos", F.col("item.input_ids").alias("id"), F.col("item.attention_mask").alias("mask"))


def catalog() -> dict[str, Query]:
    return {name: fn for name, fn in globals().items()
            if name[:1] == "q" and name[1:3].isdigit() and callable(fn)}

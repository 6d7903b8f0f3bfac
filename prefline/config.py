"""Job parameters (driver side only; nothing here touches data)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's for the same results.
# Fallback chat template: each message is  role + ": " + content + "\n\n",
# and one end-of-sequence token follows the last message.
TEMPLATE_SEPARATOR = ": "
TEMPLATE_MESSAGE_END = "\n\n"
DEFAULT_EOS = "</s>"
# The same template as a tokenizer carries it, and two other public formats.
CHAT_TEMPLATES = {
    "fallback": "{% for message in messages %}{{message['role'] + ': ' + message['content'] + '\n\n'}}{% endfor %}{{ eos_token }}",
    "im_marks": "{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\n' + message['content'] + '<|im_end|>' + '\n' }}"
                "{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\n' }}{% endif %}",
    "turn_marks": "{{ bos_token }}{% if messages[0]['role'] == 'system' %}{% set rest = messages[1:] %}{{ messages[0]['content'] | trim }}\n\n"
                  "{% else %}{% set rest = messages %}{% endif %}{% for message in rest %}"
                  "{% if message['role'] == 'assistant' %}{% set role = 'model' %}{% else %}{% set role = message['role'] %}{% endif %}"
                  "{{ '<start_of_turn>' + role + '\n' + message['content'] | trim + '<end_of_turn>\n' }}{% endfor %}"
                  "{% if add_generation_prompt %}{{'<start_of_turn>model\n'}}{% endif %}",
}
# Gemma answer wrapping.
GEMMA_ANSWER_START = "<start_of_turn>model\n"
GEMMA_ANSWER_END = "<end_of_turn>\n"
# System messages.
QUERY_SYSTEM_PROMPT = "You are an assistant who gives detailed and long answers"
PREFERENCE_SYSTEM_PROMPT = "Provide naturally sounding answers."
# Rewards: human scores are divided by 256 (half the 512-token answer budget)
# before weighting; the capped detector score is rescaled from [0, 1] to [-4, 4].
HUMAN_SCORE_DIVISOR = 256.0
CAP_MAX = 1.0
CAP_RANGE = (0.0, 1.0, -4.0, 4.0)
# Minimum review length (characters, strict) and random prefix bounds (upper exclusive).
MIN_REVIEW_CHARS = 200
PREFIX_MIN, PREFIX_MAX = 2, 8
# Token limits: query 125 (caller), 300 (function default), answers 512, scorer input 512.
QUERY_MAX_TOKENS = 125
DATASET_MAX_TOKENS = 300
MAX_NEW_TOKENS = 512
SCORER_MAX_TOKENS = 512
# Sweep search space: uniform lr, beta, label smoothing; int_uniform (inclusive)
# warmup, mini batch, accumulation; categorical loss type.  Default 10 trials.
SWEEP_SPACE = {
    "learning_rate": ("uniform", 1e-7, 1e-5),
    "beta": ("uniform", 0.3, 0.7),
    "label_smoothing": ("uniform", 0.0, 0.5),
    "warmup_steps": ("int_uniform", 130, 230),
    "mini_batch_size": ("int_uniform", 1, 4),
    "gradient_accumulation_steps": ("int_uniform", 1, 4),
    "loss_type": ("categorical", ["sigmoid", "hinge", "ipo", "robust"]),
}
SWEEP_COUNT = 10
# Log cadence: first step, then every 10th.
LOG_EVERY = 10
# Dispatch rules: the score kept from a label array is the one labelled
# "human" (compared lower-cased); a scorer whose name contains "binoculars"
# is the raw-score detector; model names containing "mistral", then "gemma",
# select the answer format; a dataset name containing "dove" holds nested
# conversations.
HUMAN_LABEL = "human"
RAW_DETECTOR_MARKER = "binoculars"
MODEL_FAMILY_MARKERS = ("mistral", "gemma")
NESTED_SOURCE_MARKER = "dove"
# A word: a run of Unicode letters, digits or underscore (Python's Unicode \w).
WORD_PATTERN = r"[\p{L}\p{N}_]+"


@dataclass(frozen=True)
class TokenConfig:
    """Reserved ids of the word-level vocabulary."""

    pad_id: int | None = 0
    unk_id: int = 1
    bos_id: int = 2
    eos_id: int = 3
    vocab_size: int | None = None  # a cap makes rarer words unknown

    @property
    def first_word_id(self) -> int:
        return max(self.pad_id or 0, self.unk_id, self.bos_id, self.eos_id) + 1

    @property
    def effective_pad_id(self) -> int:
        # No pad token -> use eos.
        return self.eos_id if self.pad_id is None else self.pad_id

    @property
    def special_ids(self) -> tuple[int, ...]:
        return tuple(sorted({self.effective_pad_id, self.unk_id, self.bos_id, self.eos_id}))


@dataclass(frozen=True)
class RewardConfig:
    """compute_reward options."""

    hf_model_weight: float = 0.5
    use_min: bool = False
    normal_training: bool = False
    use_helpfulness: bool = True

    def __post_init__(self):
        if not 0.0 <= self.hf_model_weight <= 1.0:
            raise ValueError("hf_model_weight must be in [0, 1]")


@dataclass(frozen=True)
class SplitConfig:
    """Train/eval split (L2-L4)."""

    fraction: float = 0.8
    seed: int = 42
    mode: str = "disjoint"  # or "independent" (reference behaviour: overlapping parts)
    eval_seed: int | None = None

    def __post_init__(self):
        if not 0.0 <= self.fraction <= 1.0:
            raise ValueError("fraction must be in [0, 1]")
        if self.mode not in ("disjoint", "independent"):
            raise ValueError("mode must be 'disjoint' or 'independent'")


@dataclass
class DatasetConfig:
    """build_dataset options."""

    max_length: int = DATASET_MAX_TOKENS
    sys_prompt: bool = False
    sys_prompt_text: str = QUERY_SYSTEM_PROMPT
    padding: bool = True
    padding_side: str = "left"
    eos: str = DEFAULT_EOS
    tokens: TokenConfig = field(default_factory=TokenConfig)

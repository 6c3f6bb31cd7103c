"""All constants of the retrieval and ranking plans, as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    """A text column of an item, its weight, and how many characters of it count (None: all)."""

    column: str
    weight: float
    limit: int | None = None


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values of the method; thresholds are parameters since small tables need lower ones."""

    # fields of BM25
    fields: tuple[Field, ...] = (Field("title", 4.0), Field("params", 1.0, 1000), Field("description", 0.4, 2000))
    k1: float = 1.2
    b: float = 0.75
    filter_weight: float = 0.2
    # boosts before the cut
    base_location: float = 1.2
    exact_location: float = 3.0
    category: float = 1.05
    transition_strength: float = 0.5
    # channels
    bm25_k: int = 500
    global_k: int = 1000
    exact_k: int = 200
    transition_k: int = 100
    pad_zero: bool = False
    # transitions
    prior_weight: float = 100.0
    support_weight: float = 20.0
    min_sources: int = 30
    min_count: int = 5
    min_signal: float = 0.25
    linked_locations: int = 3
    # splits
    holdout_share: float = 0.2
    secondary_texts: int = 500
    split_seed: int = 42
    secondary_seed: int = 43
    ranker_seed: int = 20260928
    train_queries: int = 10_000
    internal_queries: int = 500
    # training rows
    sampled: int = 250
    channel_head: int = 50
    hard_negatives: int = 200
    rrf: int = 60
    missing_rank: int = 2001
    # the answer
    answer_k: int = 50
    # ranker
    rounds: int = 500
    learning_rate: float = 0.05
    depth: int = 6
    min_rows: int = 100
    l2: float = 5.0
    min_gain: float = 0.01
    bins: int = 127
    truncation: int = 60
    early_stop: int = 40
    extra: dict = field(default_factory=dict)


CHANNELS = ("bm25", "global", "exact", "transition")
FEATURES = (
    "bm25_score bm25_relative lexical_score cosine cosine_gap_to_best cosine_range_normalized "
    + " ".join(f"{c}_{x}" for c in CHANNELS for x in ("rank", "rr", "present"))
    + " channel_count exact_location transition_signal category_match query_title_overlap query_title_coverage "
    "title_query_coverage query_params_overlap query_params_coverage query_description_coverage filter_params_coverage "
    "query_tokens query_chars filter_tokens title_tokens params_tokens item_rating log_reviews phone_hidden "
    "message_forbidden log_price"
).split()

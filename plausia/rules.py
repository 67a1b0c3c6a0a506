"""The rules' constants: fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    # fixed values: weights of a mention
    voice_value: dict[str, float] = field(default_factory=lambda: {"high": 1.0, "medium": 0.5, "low": 0.25})
    evidence_value: dict[str, float] = field(default_factory=lambda: {"long-term use": 1.0, "short-term use": 0.5, "no first-hand use": 0.25})
    stance_value: dict[str, int] = field(default_factory=lambda: {"recommend": 1, "warn": -1, "neutral": 0})
    honesty_bonus: float = 0.1
    decimals: int = 6
    # fixed values: the bar for picks and the lists beside it
    min_credible: int = 3
    min_threads: int = 2
    picks_shown: int = 3
    worth_credible: int = 2
    worth_min_threads: int = 2
    worth_shown: int = 3
    skip_min_warnings: int = 2
    skip_min_threads: int = 2
    skip_shown: int = 5
    disputed_min_warnings: int = 2
    # fixed values: kinds
    kind_bonus: float = 1.0
    kind_lead_ratio: float = 2.0
    kind_min_notes: int = 2
    # fixed values: upvotes that count twice, comments that stand out, well upvoted
    upvote_min_score: int = 10
    upvote_thread_min_comments: int = 20
    upvote_share_beaten: float = 0.9
    standout_min_score: int = 25
    standout_per_comment: float = 0.75
    standout_min_comments: int = 20
    standout_max_products: int = 5
    well_upvoted_share: float = 0.75
    well_upvoted_min_score: int = 3
    # fixed values: standing of a writer
    new_account_days: int = 30
    established_years: int = 2
    established_min_karma: int = 1000
    karma_per_contribution_low: float = 1.0
    karma_per_contribution_good: float = 5.0
    karma_per_year_good: float = 2000.0
    voice_high_worth: int = 2
    voice_low_flags: int = 2
    recent_years: float = 3.0
    # fixed values: copies, quotes, prices, checks
    copied_words: int = 20
    quote_max_words: int = 50
    price_max_age_days: int = 30
    check_hours: int = 48
    keep_days: int = 30
    archive_days: int = 7
    refresh_days: int = 30
    refresh_quiet_days: int = 90
    quiet_comments: int = 60


RULES = Rules()

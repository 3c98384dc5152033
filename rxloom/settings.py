"""Thresholds and switches of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    use_box_engine: bool = True
    use_word_engine: bool = True
    use_model_fallback: bool = True
    fallback_confidence: float = 0.50
    fallback_uncertain_ratio: float = 0.80
    model_confidence: float = 0.50
    low_confidence: float = 0.45
    match_threshold: float = 72.0
    certain_match: float = 85.0
    least_guess: float = 45.0
    uncertain_below: float = 0.55
    box_weight: float = 0.55
    word_weight: float = 0.45
    lenient_rows: int = 8
    default_days: int = 30
    default_time: str = "08:00"
    max_upload_mb: int = 10
    min_upload_bytes: int = 1000
    #: Rows of a dictionary, and names that are looked up in it, which a task holds at a time.
    dictionary_rows: int = 50_000
    name_rows: int = 20_000

"""Settings of the engine, passed to functions; there is no global state."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Names, markers and limits that results depend on.
    review_file: str = "_review.md"
    index_file: str = "MEMORY.md"
    sessions_dir: str = "sessions"
    chunk_chars: int = 1500
    stale_days: int = 30
    dup_threshold: float = 0.55
    link_top_n: int = 3
    link_threshold: float = 0.25
    related_start: str = "<!-- auto-related:start -->"
    related_end: str = "<!-- auto-related:end -->"
    related_heading: str = "## Связанные (авто)"
    recall_k: int = 8
    journal_entries: int = 15
    least_prompts: int = 2
    idle_minutes: int = 15
    least_growth: int = 2000
    most_per_sweep: int = 6
    sentinel: str = "HARVEST_INTERNAL_v1"
    sentinel_bytes: int = 500_000
    least_observations: int = 10
    tail_bytes: int = 120_000
    input_chars: int = 2000
    output_chars: int = 1000
    confidence: float = 0.5
    shown_instincts: int = 25
    kept_runs: int = 30
    shown_runs: int = 3
    state_lines: int = 40
    shown_projects: int = 12
    log_bytes: int = 10 << 20
    #: Minutes after which a run's lock counts as left behind.
    lock_minutes: int = 60
    #: Rows of a block whose products with another block are one task.
    block_rows: int = 2048
    #: Queries that are broadcast at once; more of them run in blocks of so many.
    block_queries: int = 1000


DEFAULTS = Settings()

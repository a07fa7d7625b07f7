"""Settings that shape results, in one object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # chunking, in tokens
    hard_tokens: int = 480
    target_tokens: int = 420
    overlap_tokens: int = 50
    outline_tokens: int = 360
    slide_pages: int = 3
    slide_tokens: int = 300
    outline_markers: int = 3
    outline_pages: int = 4
    special_tokens: int = 2
    # retrieval
    lexical_k: int = 20
    dense_k: int = 20
    rerank_n: int = 5
    final_n: int = 5
    context_tokens: int = 6000
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    # texts, in characters
    excerpt: int = 900
    summary_unit: int = 6000
    overview_line: int = 180
    batch: int = 12_000
    planner_tail: tuple[int, int] = (8, 600)
    chat_tail: tuple[int, int] = (10, 1200)
    graph_text: int = 24_000
    graph_triples: int = 80
    statement_objects: int = 4
    code_bytes: int = 1_000_000


SETTINGS = Settings()

"""All tunables in one frozen object, handed over explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # Sizes, limits, tags and wordings that stored chunks and histories were made with.
    chunk_size: int = 600
    chunk_overlap_articles: int = 0
    insert_batch: int = 10
    #: Lines dropped besides contents headings and bracketed notes (a fixed value; more titles may be added).
    title_lines: tuple[str, ...] = ("中华人民共和国刑法",)
    vector_k: int = 20
    bm25_k: int = 20
    final_k: int = 6
    rrf_k: int = 60
    retriever_k: int = 5
    source_filter: str = ""
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    keep_rounds: int = 3
    trigger_rounds: int = 5
    max_tokens: int = 4000
    summary_chars: int = 1500
    summary_enabled: bool = True
    #: Keep rounds that are neither recent nor summarised (they are dropped by default).
    lossless: bool = False
    summary_tag: str = "[SESSION_SUMMARY]"
    #: Two characters by default, as stored histories have it; "\n" is the clean choice.
    line_sep: str = "\\n"
    label_chars: int = 15
    default_label: str = "新会话"
    greeting: str = "您好，请问有什么可以帮您？"
    no_evidence: str = "无相关参考资料"

    @property
    def keep(self) -> int:
        return max(1, self.keep_rounds)

    @property
    def trigger(self) -> int:
        return max(self.keep + 1, self.trigger_rounds)

    @property
    def budget(self) -> int:
        return max(200, self.max_tokens)


DEFAULT = Config()

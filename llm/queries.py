"""All registered queries of the package."""

from llm import (  # noqa: F401
    q_chat,
    q_decontam,
    q_html,
    q_langid,
    q_lines,
    q_neardup,
    q_quality,
    q_repeats,
    q_tokens,
    q_trie,
    q_warc,
    q_whitening,
)
from llm.registry import ORACLE, QUERIES  # noqa: F401

"""Loads every operator module, so that base.QUERIES and base.ORACLES are complete."""

from matricula.llm import (  # noqa: F401
    alignment,
    mixing,
    ngram_lm,
    packing,
    pieces,
    quality,
    runs,
    simhash,
    sketches,
    topk,
    toxicity,
    url_filter,
    warc,
)
from matricula.llm.base import ORACLES, QUERIES  # noqa: F401

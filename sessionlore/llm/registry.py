"""The queries of this package by name."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, bpe, media, mixing, ngram_join, packing, pii, repair, secrets, substrings, token_files, toxicity, vectors

MODULES = (substrings, media, ngram_join, secrets, mixing, pii, vectors, toxicity, packing, token_files, bpe, alignment, repair)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}

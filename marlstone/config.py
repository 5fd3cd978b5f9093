"""Defaults of the engine. Every function takes them as arguments."""

from __future__ import annotations

TOP_K = 10
#: Fusion weights of the dense, sparse and graph sources.
FUSION_WEIGHTS = (0.4, 0.3, 0.3)
RRF_K = 60
BM25_K1, BM25_B = 1.2, 0.75
HASH_BUCKETS = 768
CONTENT_LENGTH = (50, 10000)
#: Bayesian knowledge tracing.
P_INIT, P_TRANSIT, P_SLIP, P_GUESS, VIEW_FACTOR, MASTERY_CAP, DECAY_PER_DAY = 0.1, 0.3, 0.1, 0.2, 0.3, 0.99, 0.05
MASTERY_THRESHOLD = 0.7
#: Weights of relation types in path scores; fixed values.
RELATION_WEIGHTS = {"PREREQUISITE": 1.0, "EQUIVALENT": 0.9, "RELATED_TO": 0.8, "PART_OF": 0.7, "IS_A": 0.6}
OTHER_RELATION_WEIGHT = 0.5
#: The seven weight triples of the ablation; fixed values.
ABLATION = (
    ("dense_only", 1.0, 0.0, 0.0),
    ("sparse_only", 0.0, 1.0, 0.0),
    ("kg_only", 0.0, 0.0, 1.0),
    ("dense_sparse", 0.6, 0.4, 0.0),
    ("dense_kg", 0.6, 0.0, 0.4),
    ("sparse_kg", 0.0, 0.6, 0.4),
    ("full", 0.4, 0.3, 0.3),
)

"""Parameters of the registered queries, shared by the Spark side and the SQL side.

The given texts are invented prose, so the default keyword sets hardly occur in them; these sets
reach every branch.
"""

from __future__ import annotations

from narrascope.operators.topics import EXTRA_STOP_WORDS

LEXICON = (
    ("and", 0.4), ("with", 1.2), ("that", -0.6), ("for", 0.8), ("was", -1.5), ("this", 1.0),
    ("are", -0.9), ("from", 0.5), ("der", -1.1), ("die", -1.3), ("que", 0.7), ("des", -0.4),
    ("les", 0.9), ("und", 0.3),
)
# (word, kind, step)
RULES = (
    ("the", "booster", 0.293), ("of", "booster", -0.293), ("in", "negation", 0.0), ("zu", "negation", 0.0),
    ("par", "negation", 0.0), ("to", "contrast", 0.0), ("el", "contrast", 0.0), ("le", "booster", 0.293),
)
POSITIVE_KEYWORDS = ("with", "this", "les")
NEGATIVE_KEYWORDS = ("that", "der", "que")

# (ord, raw symbol); the meaning is "meaning <ord>".
DICTIONARY = (
    (1, "The\nAnd"), (2, "Of the"), (3, "to the"), (4, "And attion to"), (5, "er ntre in"),
    (6, "in onbleea of"), (7, "Der"), (8, "les"), (9, "With"), (10, " with "), (11, "que"),
    (12, "from this place now"), (13, "o'clock"), (14, "zzzz"),
)

STOP_WORDS = tuple(
    sorted({*EXTRA_STOP_WORDS, "the", "and", "that", "for", "with", "der", "die", "und", "les", "que"})
)

MIN_TURNS = 5
SAMPLE_SIZE, SAMPLE_SEED = 150, 42
N_AXES, PER_POLE, N_ROUNDS, ROUND_SEED = 5, 20, 3, 42
BINS, PER_LABEL = 20, 10
HASH_DIM = 64
AXES = ("PC1", "PC2", "PC3", "PC4", "PC5")
HUMAN = "m0"
N_CENTRES = 4
# One pass of the topic fit: the most frequent terms, topics, inner steps.
STEP_TERMS, STEP_TOPICS, STEP_INNER = 30, 3, 2
MANY_KEYWORDS = 5_000

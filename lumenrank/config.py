"""Default parameters and fixed values.

Everything here is a plain constant so that an operator's behaviour is fully
described by its arguments; callers override per call, never by mutation.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# These must equal the original's for the same results.
# ---------------------------------------------------------------------------
DEPTH = 200                      # top-k per retriever (dense and BM25)
RRF_K = 60                       # reciprocal-rank-fusion constant
LISTWISE_TOP_N = 10              # listwise window
LISTWISE_MAX_NEW_TOKENS = 128
HYDE_MAX_NEW_TOKENS = 96
NEGATIVE_NUMBER = 15             # mined negatives per training row
MINING_RANGE_DEFAULT = "10-210"  # option default
MINING_RANGE_SCRIPT = "2-200"    # value the launcher uses
HIT_KS = (1, 10, 100)            # hit@k list
HYDE_PROMPT_PREFIX = "Write a concise passage that directly answers the question.\nQuestion: "
HYDE_PROMPT_SUFFIX = "\nPassage:"
LISTWISE_PROMPT_PREFIX = "Query: "
LISTWISE_PROMPT_MIDDLE = "\nHere are candidate documents:\n"
LISTWISE_PROMPT_SUFFIX = (
    "\nReturn the indices of the most relevant documents in order, "
    "separated by spaces or commas."
)

# ---------------------------------------------------------------------------
# Our own choices (not taken from the original).
# ---------------------------------------------------------------------------
# Tokeniser: maximal runs of Unicode letters and digits after lower-casing.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Whitespace as Python's str.strip() sees it, written for both Java regex and RE2.
WS_CLASS = r"[\s\x0B\p{Z}\x1C-\x1F\x85]"
BM25_K1 = 0.9
BM25_B = 0.4
HASH_DIM = 256                   # hashing-encoder width
SCORE_DIGITS = 6                 # rounding of output scores
SEED = "lumenrank"               # seed for hash-ordered sampling
# Largest query block shipped to executors as one broadcast (bytes).
QUERY_BLOCK_BYTES = 32 * 1024 * 1024
# Largest measured size of a side that a join may broadcast (bytes).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# A key of a lookup is hot from so many rows on; at most so many keys are.
HOT_ROWS = 10_000
HOT_KEYS = 1_000
# Instruction of the registered example query (any text; models differ in what they want).
QUERY_INSTRUCTION = "Represent this question for finding passages: "
QUERY_INSTRUCTION_FORMAT = "{}{}"
TASK_EXAMPLES = "Question: which river is longest? Passage: The longest river is the Nile.\n"
TASK_EXAMPLES_FORMAT = "Examples: {}{}"

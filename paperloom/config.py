"""Fixed values of the retrieval engine, as data."""

from __future__ import annotations

# Collections in their order of legal rank, with weights and quotas of the weighted search.
COLLECTIONS = ["constitution", "uu", "pp", "perpres", "permen", "kepmen", "perda", "lainnya"]
QUOTAS = {"constitution": 3, "uu": 4, "pp": 2}
COLLECTION_PREFIX = "indonesia_"
VERSION_PREFIX = "v2_"

# Per intent how many results are given, how many candidates are diversified, how many a list gives.
STRATEGIES = {
    "single_answer": (8, 30, 20), "article_lookup": (12, 40, 30), "hierarchy": (18, 60, 30), "comparison": (20, 60, 30),
    "case_application": (18, 60, 30), "general": (15, 50, 30),
}
# How many sources are kept for intents that compare, and the fewest rows that must survive.
TOP_SOURCES = {"comparison": 4, "hierarchy": 5, "case_application": 5}
FEWEST_ROWS = 12

RRF_K = 60
AUTO_BOOST = 0.92
EARLY_PAGE, EARLY_PENALTY, OLD_EARLY_PENALTY = 2, 1.10, 1.15
NO_PAGE = 99
MMR_LAMBDA = 0.7
DIVERSITY_STEP, DIVERSITY_FLOOR = 0.15, 0.55
RERANK_CUT, DEFAULT_SCORE = 20, 5.0
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
MAX_FILE_BYTES = 60 * 1024 * 1024
MTIME_SLACK = 1.0
MAX_QUERIES, MAX_SUB_QUERIES, MAX_HYPOTHESES = 10, 4, 3
TOOL_CHUNKS, TOOL_CHARS, TOOL_SCAN = 8, 800, 200
SNIPPET_CHARS, CONTEXT_CHARS = 240, 1500
HISTORY_ITEMS, HISTORY_MESSAGES = 30, 10
SESSION_IDLE = "1 hour"
CHUNK_SIZE, CHUNK_OVERLAP = 700, 120
STRUCT_TARGET, STRUCT_MAX, STRUCT_MIN, STRUCT_OVERLAP = 1200, 1800, 80, 180

# File name prefixes, the first that fits decides.
SOURCE_PREFIXES = [
    ("UUD_", "constitution"), ("UU_7-1950_UUDS", "constitution"), ("UU_11-1949_Konstitusi", "constitution"), ("UU_", "uu"), ("PP_", "pp"),
    ("Perpres_", "perpres"), ("Permen", "permen"), ("Kepmen", "kepmen"), ("Perda_", "perda"), ("Inpres_", "lainnya"),
]
# What callers may call a collection.
ALIASES = {"heonbeob": "constitution"} | {c: c for c in COLLECTIONS}
# Folder names with a collection of another name.
FOLDER_OVERRIDES = {"헌법": "constitution"}
# Display names.
DISPLAY = {"constitution": "헌법", "uu": "법률", "pp": "정부령", "perpres": "대통령령", "permen": "장관령", "kepmen": "장관결정", "perda": "조례", "lainnya": "기타"}

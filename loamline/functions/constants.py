"""Fixed values that results depend on."""

#: Words that carry no topic. They are looked for after stemming.
STOPWORDS = frozenset(
    """
    a about above after again against all also am an and any are as at be because been before being below between both
    but by can did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
    our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
    these they this those through to too under until up very was we were what when where which while who whom why will
    with you your yours yourself yourselves
    """.split()
)

#: Words that stand for each other. The key is matched after stemming, the values are stemmed when added.
ALIASES = {
    "auth": ["authentication", "identity", "login", "session"],
    "authentication": ["auth", "identity", "login", "session"],
    "build": ["ship", "implement", "create", "make"],
    "changed": ["shift", "pivot", "direction", "rewrite"],
    "change": ["shift", "pivot", "direction", "rewrite"],
    "complexity": ["risk", "friction", "maintenance", "tradeoff"],
    "cost": ["budget", "price", "expense", "tradeoff"],
    "decision": ["choice", "adr", "direction", "tradeoff"],
    "direction": ["change", "shift", "strategy", "decision"],
    "memory": ["recall", "context", "knowledge", "notes"],
    "notes": ["memory", "knowledge", "writing", "docs"],
    "problem": ["issue", "risk", "blocker", "challenge"],
    "search": ["retrieval", "recall", "find", "lookup"],
    "session": ["auth", "authentication", "identity", "login"],
    "tension": ["tradeoff", "conflict", "risk", "constraint"],
    "user": ["customer", "person", "people", "reader"],
}

#: What the settings are when nothing else is said.
CHUNK_SIZE_WORDS = 260
CHUNK_OVERLAP_WORDS = 48
EMBEDDING_DIMENSIONS = 384
EMBEDDING_BATCH_SIZE = 16
EMBEDDING_MODEL = "Xenova/bge-small-en-v1.5"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
PASSAGE_PREFIX = ""
EXTENSIONS = (".md", ".mdx", ".txt")
EXCLUDED_DIRS = (".git", ".hg", ".svn", ".loamline", ".obsidian", ".trash", ".venv", "coverage", "dist", "node_modules")
MAX_FILES = 1024
MAX_RESULTS = 8
MIN_ENTITY_DOCUMENTS = 1
RECENCY_HALF_LIFE_DAYS = 180
SELECTED_ENTITY_LIMIT = 48

#: Sizes of intermediate lists.
LINKS_PER_PROBE = 24
LINKS_PER_PROBE_APPLIED = 32
PROBES_SCORED = 10
PROBES_SHOWN = 5
SNIPPET_CHARS = 900

"""Fixed values of the data model: results depend on them being exactly these."""

# fixed values: expertise domains and their keywords
DOMAIN_KEYWORDS = {
    "Authentication": ("auth", "jwt", "login", "password", "token", "session", "oauth", "credential"),
    "Storage": ("storage", "db", "database", "sqlite", "postgres", "sql", "persistence", "query"),
    "Context Engine": ("context", "generator", "briefing", "render", "template"),
    "MCP": ("mcp", "protocol", "stdio", "transport", "tool"),
    "Agent Intelligence": ("agent", "onboarding", "guidance", "impact", "qa", "question", "answer"),
    "Infrastructure": ("infra", "docker", "pipeline", "ci/cd", "actions", "deploy", "setup"),
}

# fixed values: words that never link two titles
STOP_WORDS = ("use", "uses", "using", "introduce", "introduces", "introducing", "implement", "implements", "implementing", "add", "adds", "adding", "new", "to", "the", "a", "an", "for", "in", "of", "and", "or", "with", "by", "on", "at", "from", "feat", "fix", "chore", "docs", "refactor")

# fixed values: words that open an intent
INTENT_WORDS = ("improve", "reduce", "increase", "optimize", "enhance", "simplify", "minimize", "accelerate", "stabilize", "secure")

# fixed values: commit prefixes and the events they stand for
COMMIT_EVENTS = {
    "feat": "FEATURE_INTRODUCED",
    "feature": "FEATURE_INTRODUCED",
    "fix": "DEFECT_RESOLVED",
    "bugfix": "DEFECT_RESOLVED",
    "refactor": "CODE_REFACTORED",
    "docs": "DOCUMENTATION_UPDATED",
    "chore": "MAINTENANCE_PERFORMED",
}

# fixed values: weights of the expertise score and the days that count as recent
WEIGHTS = {"commits": 1.0, "decisions": 5.0, "facts": 2.0, "events": 3.0}
RECENT_DAYS = 30

# fixed values: match scores and how sources rank on equal score
EXACT, PREFIX, PARTIAL, WEAK = 100, 75, 50, 25
PRECEDENCE = {"memory": 4, "ownership": 3, "graph": 2, "discovery": 1}

# fixed values: BM25 parameters, deepest path, rows of the ranked reports
K1, B = 1.2, 0.75
MAX_DEPTH, TOP_TEXT, TOP_CODE = 10, 100, 20

# fixed values: folders that hold decision records, with their kind
RECORD_FOLDERS = (("docs/adr", "adr"), ("docs/adrs", "adr"), ("docs/decisions", "adr"), ("docs/rfc", "adr"), ("adr", "adr"), ("adrs", "adr"), ("docs/architecture", "architecture_doc"))

# fixed values: words that a question's terms leave out
ASK_STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "who", "with", "what", "created", "worked", "touched", "owns", "own", "component", "feature", "server")

# fixed values: words that hold a change back, first words of a task, most items in an answer's lists
BLOCKERS = ("migration", "schema", "database", "breaking", "deprecat", "ddl")
TASK_VERBS = ("add", "implement", "fix", "refactor", "update", "create", "build", "integrate", "remove", "migrate", "support", "introduce")
CAPS = {"related": 15, "evidence": 20, "starts": 8, "areas": 15, "links": 12, "reuse": 15, "ship": 10, "checks": 12, "files": 30}
TOKEN_BUDGET = 1500

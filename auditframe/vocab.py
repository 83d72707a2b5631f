"""Word lists, lookup tables, patterns and weights.

All of these must equal the audited tool's values for results to agree.
"""

# SQL log analysis ------------------------------------------------
IMPACT_HIGH_MS = 10000
IMPACT_MEDIUM_MS = 1000
LOG_QUERY_TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE")

TEXT_LOG_TIMESTAMP = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})"
TEXT_LOG_QUERY = r"Query:\s*(.+?)(?:;|\s+Duration:)"
TEXT_LOG_DURATION = r"Duration:\s*(\d+(?:\.\d+)?)ms"

# Schema dumps ----------------------------------------------------
DDL_TABLE = r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)"
DDL_COLUMN = r"(\w+)\s+(VARCHAR|INT|INTEGER|TEXT|DECIMAL|DATE|TIMESTAMP|BOOLEAN)"
DDL_INDEX = r"CREATE\s+(?:UNIQUE\s+)?INDEX\s+(\w+)\s+ON\s+(\w+)"

# Redaction, applied in this order --------------------------------
REDACTION_PATTERNS = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b[A-Za-z0-9]{32,}\b",
    r"AKIA[0-9A-Z]{16}",
    r'token["\s:=]+[A-Za-z0-9_\-]{20,}',
    r'password["\s:=]+\S+',
)
REDACTION_MARK = "[REDACTED]"

# Document risk patterns ------------------------------------------
TRIBAL_PATTERNS = (
    r"contact\s+(\w+)",
    r"ask\s+(\w+)",
    r"only\s+(\w+)\s+knows",
    r"(\w+)\s+is\s+the\s+only\s+one",
    r"reach\s+out\s+to\s+(\w+)",
    r"see\s+(\w+)\s+for",
)
MANUAL_PATTERNS = (
    r"manually\s+(\w+)",
    r"run\s+this\s+command",
    r"execute\s+the\s+following",
    r"ssh\s+into",
    r"log\s+into",
)
# No pattern above can match fewer characters than this ("ask x").
SHORTEST_DOCUMENT_MATCH = 5

RECOMMENDATION_BULLET = r"^[\d\-\*•]\s*\.?\s+"
RECOMMENDATION_KEYWORDS = ("optimize", "improve", "add", "remove", "consider", "recommend", "suggest")

# Security patterns, first hit per issue type wins ----------------
SECURITY_PATTERNS = {
    "hardcoded_password": (
        r"""password\s*=\s*["']([^"']+)["']""",
        r"""passwd\s*=\s*["']([^"']+)["']""",
        r"""pwd\s*=\s*["']([^"']+)["']""",
    ),
    "api_key": (
        r"""api_key\s*=\s*["']([^"']+)["']""",
        r"""api_secret\s*=\s*["']([^"']+)["']""",
        r"""secret_key\s*=\s*["']([^"']+)["']""",
    ),
    "sql_injection": (
        r"""execute\s*\(\s*["'].*%s.*["']""",
        r"""query\s*\(\s*["'].*\+.*["']""",
        r"""\.format\s*\(.*sql.*\)""",
    ),
    "insecure_connection": (
        r"""http://(?!localhost|127\.0\.0\.1)""",
        r"""verify\s*=\s*False""",
        r"""ssl_verify\s*=\s*False""",
    ),
}
SECURITY_SEVERITY = {
    "hardcoded_password": "CRITICAL",
    "api_key": "CRITICAL",
    "sql_injection": "HIGH",
    "insecure_connection": "MEDIUM",
}
SECURITY_MITIGATION = {
    "hardcoded_password": "Move credentials to environment variables or secrets manager",
    "api_key": "Store API keys in environment variables or secrets manager",
    "sql_injection": "Use parameterized queries or ORM with proper escaping",
    "insecure_connection": "Enable SSL/TLS verification and use HTTPS",
}

# Scoring and effort ----------------------------------------------
SEVERITY_WEIGHT = {"CRITICAL": 10.0, "HIGH": 7.0, "MEDIUM": 4.0, "LOW": 2.0}
SEVERITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4}
PRIORITY_SCORE = {"CRITICAL": 10, "HIGH": 7, "MEDIUM": 4, "LOW": 2}
CATEGORY_EFFORT = {"security": "MEDIUM", "spof": "HIGH", "documentation": "LOW", "manual_ops": "MEDIUM"}
SPOF_SEVERITY = {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW"}
SPOF_THRESHOLD = 0.1
SPOF_HIGH_THRESHOLD = 0.3
SAVINGS_SHARE = 0.4

# Engagement lifecycle --------------------------------------------
LIFECYCLE_NEXT = {
    "new": ["ingested"],
    "ingested": ["analyzed"],
    "analyzed": ["reviewed"],
    "reviewed": ["finalized"],
    "finalized": [],
}
TRANSITION_ARTIFACTS = {
    ("new", "ingested"): ["repo_inventory", "db_schema"],
    ("ingested", "analyzed"): ["topology", "cost_drivers", "risk_register"],
    ("analyzed", "reviewed"): ["review_approval"],
    ("reviewed", "finalized"): ["executive_summary", "technical_appendix"],
}
REVIEW_STATUSES = ("pending", "approved", "rejected", "request_changes")

# File-name tables --------------------------------------------------
INVENTORY_LANGUAGES = {
    ".py": "Python", ".java": "Java", ".js": "JavaScript", ".ts": "TypeScript",
    ".jsx": "JavaScript", ".tsx": "TypeScript", ".go": "Go", ".rs": "Rust",
    ".c": "C", ".cpp": "C++", ".h": "C/C++ Header", ".cs": "C#", ".rb": "Ruby",
    ".php": "PHP", ".sql": "SQL", ".sh": "Shell", ".bash": "Bash",
    ".ps1": "PowerShell", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON",
    ".xml": "XML", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".md": "Markdown",
}
EXTRACTOR_LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript",
    ".jsx": "javascript", ".tsx": "typescript", ".cs": "csharp", ".php": "php",
    ".rb": "ruby", ".go": "go", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".sql": "sql", ".pl": "perl", ".cbl": "cobol", ".cob": "cobol",
}
GRAPH_LANGUAGES = {
    ".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".java": "Java",
    ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".cs": "C#",
    ".cpp": "C++", ".c": "C",
}
GRAMMAR_LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "tsx", ".cs": "c_sharp", ".php": "php",
    ".go": "go", ".rb": "ruby", ".rs": "rust", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".hpp": "cpp", ".sql": "sql",
}
GRAMMAR_TWIN_LANGUAGES = {
    ".py": "python", ".java": "java", ".js": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "c_sharp",
    ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".sh": "bash",
    ".sql": "sql",
}
DATABASE_USER_EXTENSIONS = (".py", ".js", ".ts", ".java", ".go", ".rs", ".rb", ".php")
RISK_CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".java", ".cpp", ".c", ".cs", ".go", ".rb", ".php",
    ".scala", ".kt", ".swift", ".rs", ".sql",
)
DOCUMENT_EXTENSIONS = (".md", ".txt")
BINARY_EXTENSIONS = (".exe", ".dll", ".so", ".class")
DEPENDENCY_MANIFESTS = (
    "requirements.txt", "Pipfile", "pyproject.toml", "package.json",
    "package-lock.json", "pom.xml", "build.gradle", "Gemfile", "composer.json",
    "go.mod", "Cargo.toml",
)
SKIP_DIRECTORIES = (
    ".git", ".svn", "node_modules", "__pycache__", "venv", "env", ".venv",
    "dist", "build", "target", ".idea", ".vscode",
)

# Embedded SQL and database calls in source code --------------------
TABLE_AFTER_FROM = r"FROM\s+(\w+)"
TABLE_AFTER_INTO = r"INTO\s+(\w+)"
TABLE_AFTER_UPDATE = r"UPDATE\s+(\w+)"
TABLE_AFTER_TABLE = r"TABLE\s+(\w+)"

PYTHON_SQL_GATE = r"\b(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|FROM|WHERE|JOIN)\b"
PYTHON_SQL_EXECUTE = r"""\.execute\s*\(\s*["'](.+?)["']"""
PYTHON_SQL_STRING = r"""["'](.+?)["']"""
JAVA_SQL_GATE = r"(SELECT|INSERT|UPDATE|DELETE|CREATE)\b"
JAVA_SQL_STRING = r"""["']([^"']*(?:SELECT|INSERT|UPDATE|DELETE|CREATE)[^"']*)["']"""
CODE_SQL_GATE = r"(SELECT|INSERT|UPDATE|DELETE)\b"
CODE_SQL_STRING = r"""["']([^"']*(?:SELECT|INSERT|UPDATE|DELETE)[^"']*)["']"""
CODE_SQL_TEMPLATE = r"""`([^`]*(?:SELECT|INSERT|UPDATE|DELETE)[^`]*)`"""
CSHARP_SQL_STRING = r"""@?"([^"]*(?:SELECT|INSERT|UPDATE|DELETE)[^"]*)\""""
GENERIC_SQL_GATE = r"\b(SELECT|INSERT|UPDATE|DELETE)\b"

STATEMENT_TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP")
CONTAINED_TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE")

JAVA_IMPORT = r"import\s+([\w.]+)\s*;"
JS_IMPORTS = (
    r"""import\s+.*?\s+from\s+['"]([^'"]+)['"]""",
    r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)""",
)
CSHARP_IMPORT = r"using\s+([\w.]+)\s*;"
PHP_IMPORTS = (
    r"""require\s+["']([^"']+)["']""",
    r"""require_once\s+["']([^"']+)["']""",
    r"""include\s+["']([^"']+)["']""",
    r"""include_once\s+["']([^"']+)["']""",
)

# Fixed values: (pattern, reported name) of database calls per language
DATABASE_CALLS = {
    "java": (
        (r"\.executeQuery\s*\(", "executeQuery"),
        (r"\.executeUpdate\s*\(", "executeUpdate"),
        (r"\.execute\s*\(", "execute"),
        (r"\.prepareStatement\s*\(", "prepareStatement"),
        (r"\.createQuery\s*\(", "createQuery"),
    ),
    "javascript": (
        (r"\.query\s*\(", "query"),
        (r"\.execute\s*\(", "execute"),
        (r"\.run\s*\(", "run"),
        (r"\.all\s*\(", "all"),
        (r"\.get\s*\(", "get"),
    ),
    "csharp": (
        (r"\.ExecuteReader\s*\(", "ExecuteReader"),
        (r"\.ExecuteScalar\s*\(", "ExecuteScalar"),
        (r"\.ExecuteNonQuery\s*\(", "ExecuteNonQuery"),
        (r"new SqlCommand\s*\(", "SqlCommand"),
    ),
    "php": (
        (r"mysql_query\s*\(", "mysql_query"),
        (r"mysqli_query\s*\(", "mysqli_query"),
        (r"->query\s*\(", "query"),
        (r"->execute\s*\(", "execute"),
        (r"->prepare\s*\(", "prepare"),
    ),
}
PYTHON_CALL_WORDS = ("execute", "query", "fetch")

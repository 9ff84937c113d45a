"""Rules as data."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions and the languages they stand for.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript",
    ".py": "Python", ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".h": "C", ".cpp": "C++",
    ".hpp": "C++", ".cs": "C#", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".sh": "Shell", ".sql": "SQL", ".css": "CSS",
    ".scss": "CSS", ".html": "HTML", ".md": "Markdown", ".json": "JSON", ".yml": "YAML", ".yaml": "YAML",
}
CODE = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".rb", ".php", ".c", ".h", ".cpp", ".hpp", ".cs", ".swift", ".kt"]
SCRIPTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
SKIPPED_DIRS = [".git", "node_modules", "dist", "build", ".next", "out", "vendor", "__pycache__", ".venv", "venv", "target", ".idea", ".vscode", "coverage"]

# Dimensions with their weights in the overall score.
DIMENSIONS = [("correctness", 0.26), ("security", 0.24), ("maintainability", 0.22), ("dependency_hygiene", 0.16), ("test_integrity", 0.12)]

# Title, pattern, dimension, severity, confidence, extensions (none: all). Order matters. The local-URL pattern is written without look-behind, so that RE2 takes it too.
LINE_RULES = [
    ("Use of eval()", r"\beval\s*\(", "security", 5, 0.95, []),
    ("Shell/process execution", r"child_process|os\.system\(|subprocess\.(call|run|Popen)\(", "security", 3, 0.85, []),
    ("Possible hardcoded secret", r"(?i)(password|secret|api[_-]?key|token)\s*[:=]\s*['\"]([^'\"]{6,})['\"]", "security", 5, 0.8, []),
    ("Hardcoded local URL", r"https?://(?:[^\"'\s]*[^\w.\"'\s])?(?:localhost|127\.0\.0\.1)", "security", 2, 0.9, []),
    ("Raw HTML injection sink", r"\bdangerouslySetInnerHTML\b|innerHTML\s*=", "security", 3, 0.95, []),
    ("Possible SQL string concatenation", r"(?i)SELECT\s+.+\+|query\(\s*['\"`].*\$\{", "security", 4, 0.7, []),
    ("Leftover debug output", r"\bconsole\.(log|debug)\b|^\s*print\(", "correctness", 1, 1.0, []),
    ("debugger statement", r"\bdebugger\b", "correctness", 2, 1.0, []),
    ("Empty catch block", r"catch\s*\([^)]*\)\s*\{\s*\}", "correctness", 3, 0.9, []),
    ("TODO/FIXME marker", r"\bTODO\b|\bFIXME\b|\bHACK\b|\bXXX\b", "maintainability", 1, 1.0, []),
    ("Suppressed checker", r"@ts-(ignore|nocheck)|# type: ignore|eslint-disable", "maintainability", 2, 1.0, []),
    ("Untyped `any`", r":\s*any\b|\bas\s+any\b", "correctness", 1, 1.0, [".ts", ".tsx"]),
]
SECRET = "Possible hardcoded secret"
# Every line that a rule hits holds one of its literals. Most are cut to begin with a rare letter, as a search halts wherever the first one stands. No literal tells secrets, so they have a pattern.
LINE_CLUES = {
    "Use of eval()": ["val"],
    "Shell/process execution": ["_process", ".system(", "subprocess."],
    "Hardcoded local URL": ["localhost", "127.0.0.1"],
    "Raw HTML injection sink": ["HTML"],
    "Possible SQL string concatenation": ["+", "${"],
    "Leftover debug output": [".log", ".debug", "print("],
    "debugger statement": ["bugger"],
    "Empty catch block": ["catch"],
    "TODO/FIXME marker": ["TODO", "FIXME", "HACK", "XXX"],
    "Suppressed checker": ["@ts-", "# type: ignore", "-disable"],
    "Untyped `any`": ["any"],
}
SECRET_CLUE = r"[:=]\s*['\"]"
PLACEHOLDER = r"(?i)^(\.{3,}|x{4,}|\*{4,}|your[-_ ]?\w*|example\w*|placeholder\w*|changeme|insert[-_ ]?\w*|redacted|dummy|fake|sample|todo|<.*>|\{\{.*\}\})$"

# Lint rules that need no more than a line here: title, pattern, severity, confidence. An approximation of rules that are defined on syntax trees.
LINT_RULES = [
    ("ReDoS-vulnerable regular expression", r"/[^/\n]*\([^()/\n]*[+*][^()/\n]*\)[+*][^/\n]*/", 3, 0.85),
    ("Regular expression built from a variable", r"new\s+RegExp\(\s*[A-Za-z_$]", 2, 0.7),
    ("Filesystem path built from a variable", r"\bfs\.\w+\(\s*[A-Za-z_$][\w$.]*\s*[,)]", 3, 0.7),
    ("Dynamic require() path", r"\brequire\(\s*[A-Za-z_$]", 3, 0.7),
    ("Indirect/computed eval()", r"\beval\(\s*[A-Za-z_$]", 5, 0.9),
    ("Weak (non-cryptographic) randomness", r"\bpseudoRandomBytes\b", 3, 0.9),
    ("Dynamic child_process invocation", r"\b(?:exec|execSync|spawn)\(\s*[A-Za-z_$]", 3, 0.75),
    ("Unsafe Buffer read/write (noAssert)", r"\.(?:read|write)\w+\([^)]*,\s*true\s*\)", 3, 0.85),
    ("Deprecated, unsafe `new Buffer()`", r"\bnew\s+Buffer\(", 2, 0.9),
    ("Disabled template auto-escaping (XSS risk)", r"escapeMarkup\s*=\s*false", 4, 0.85),
]

# Concepts and the words that stand for them.
TAGS = [
    ("auth", "auth|login|logout|session|token|jwt|password|credential|oauth|permission"),
    ("db", "db|database|query|sql|repository|model|schema|migration|orm|prisma|sqlite|postgres"),
    ("http", "http|request|response|route|controller|endpoint|api|fetch|axios|handler|middleware"),
    ("ui", "render|component|view|button|modal|page|props|state|hook|css|style"),
    ("test", "test|spec|mock|fixture|assert|expect|describe"),
    ("crypto", "hash|encrypt|decrypt|cipher|sign|verify|crypto|secret"),
    ("io", "read|write|file|stream|buffer|fs|path|serialize|parse|json"),
    ("config", "config|setting|env|option|flag|constant|default"),
    ("error", "error|exception|throw|catch|fail|panic|validate|validation"),
]
STOP_WORDS = ["a", "an", "the", "to", "and", "or", "of", "in", "on", "for", "with", "my", "is", "this", "that", "code", "function", "please"]
ENTRY_POINTS = r"(?i)^(main|default|handler|index|render|app|page|route|get|post|put|delete|constructor)$"
TEST_PATH = r"(?i)(\.|_|/)(test|spec)|(^|/)tests?/"
TEST_FILE = r"(?i)(\.|_|/)(test|spec)\.|(^|/)tests?/"

# How declarations, imports, comments, branches and calls look in a line of source text.
SCRIPT_TYPE = r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(class|interface)\s+([\w$]+)"
SCRIPT_FUNCTION = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([\w$]+)\s*(\([^)]*\))"
SCRIPT_CONST = r"^(?:export\s+)?(?:default\s+)?const\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>|function)"
SCRIPT_METHOD = r"^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*([\w$]+)\s*(\([^)]*\))\s*(?::[^={]+)?\{"
SCRIPT_IMPORT = r"^import\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\})?\s*(?:\*\s*as\s+([\w$]+))?\s*(?:from\s+)?[\"']([^\"']+)[\"']"
PYTHON_CLASS = r"class\s+(\w+)"
PYTHON_DEF = r"(\s*)(?:async\s+)?def\s+(\w+)\s*(\([^)]*\))"
PYTHON_FROM = r"from\s+(\.*[\w.]*)\s+import\s+(.+)$"
PYTHON_IMPORT = r"import\s+([\w.]+)(?:\s+as\s+(\w+))?"
RENAMED = r"\s+as\s+"
REMARK_MARKS = r"^/\*\*?|\*/$|^\*\s?|^//\s?"
HEAD_CHARS = 100  # of a declaration that its signature is taken from
REMARK_STARTS = ("*", "/**", "//")
REMARK_LEAD = r"^(/\*\*?|\*\s?|//\s?)"
BRANCH = r"\b(?:if|for|while|do|catch|case)\b|&&|\|\||\?(?![.?])"
CALLED = r"([A-Za-z_$][\w$]*)\s*\("
NO_METHODS = {"if", "for", "while", "switch", "catch", "return", "function", "await", "typeof", "super", "new", "in", "of"}

# Statements that fixers take out or look at.
SCRIPT_DEBUG = r"^console\.(log|debug|info)\(.*\)\s*;?\s*$"
SCRIPT_DEBUGGER = r"^debugger\s*;?\s*$"
PYTHON_PRINT = r"^print\(.*\)\s*$"
PYTHON_OPENER = r"^(async\s+)?(if|elif|else|for|while|try|except|finally|with|def|class)\b.*:\s*(#.*)?$"


def tags(name: Column, signature: Column, doc: Column) -> Column:
    """The concepts of a symbol, in their fixed order."""
    hay = F.concat_ws(" ", name, signature, F.coalesce(doc, F.lit("")))
    return F.filter(F.array(*[F.when(hay.rlike(rf"(?i)\b({words})\b"), F.lit(tag)) for tag, words in TAGS]), lambda t: t.isNotNull())


def clue(text: Column, title: str) -> Column:
    """Whether a line, or any line of a text, may hit a rule: far cheaper than its pattern, and true wherever that matches."""
    if title == SECRET:
        return (text.contains("=") | text.contains(":")) & text.rlike(SECRET_CLUE)
    return functools.reduce(operator.or_, [text.contains(word) for word in LINE_CLUES[title]])


def is_placeholder(value: Column) -> Column:
    return value.rlike(PLACEHOLDER) | value.contains("...")

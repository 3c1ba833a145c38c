"""Rule catalogues and other values fixed by the tool whose results we match.

Patterns are in the RE2 dialect; ``functions.regex.to_java`` adapts them.  ``needs`` of a rule are
texts of which each match holds one, in lower case where the pattern ignores case; a line with
none of them is not searched.  No text means that every line is searched.  U+017F in such a text
stands for 's' as well (see ``functions.prefilter``).
"""

from __future__ import annotations

from typing import NamedTuple


class LineRule(NamedTuple):
    """A Phase 1 rule: every match on an added line is a finding."""

    rule_id: str
    pattern: str
    message: str
    severity: str
    file_exts: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


class AgentRule(NamedTuple):
    """A rule of the built-in agent: the first match on a line is the finding."""

    pattern: str
    vuln_class: str
    severity: str
    cwe: str
    description: str
    confidence: float
    needs: tuple[str, ...] = ()


# --- Fixed values: must equal the originals for equal results -----------------------

RULES_VERSION = "1.0.0"

LINE_RULES: tuple[LineRule, ...] = (
    LineRule(
        "fallback-hardcoded-aws-key",
        r"(?i)(AKIA[0-9A-Z]{16})",
        "Possible hardcoded AWS access key detected",
        "CRITICAL",
        needs=("akia",),
    ),
    LineRule(
        "fallback-hardcoded-secret",
        r"""(?i)(api[_-]?key|secret[_-]?key|password|token|auth[_-]?token)\s*[:=]\s*["'][\w/+=-]{8,}["']""",
        "Possible hardcoded secret or credential",
        "ERROR",
        needs=("api", "ecret", "token", "word"),
    ),
    LineRule(
        "fallback-private-key",
        r"-----BEGIN\s+(RSA|EC|DSA|OPENSSH)?\s*PRIVATE KEY-----",
        "Private key embedded in source code",
        "CRITICAL",
        needs=("PRIVATE KEY-----",),
    ),
    LineRule(
        "fallback-sql-concat",
        r"""(?i)(query|exec|execute|raw)\s*\(\s*["']?\s*SELECT|INSERT|UPDATE|DELETE.*\+""",
        "Possible SQL injection via string concatenation",
        "ERROR",
        (".go", ".py", ".js", ".ts", ".java", ".rb", ".php"),
        needs=("delete", "elect", "in\u017fert", "update"),
    ),
    LineRule(
        "fallback-eval-usage",
        r"\beval\s*\(",
        "Use of eval() — potential code injection vector",
        "ERROR",
        (".js", ".ts", ".py", ".rb", ".php"),
        needs=("eval",),
    ),
    LineRule(
        "fallback-exec-usage",
        r"(?i)\b(os\.system|subprocess\.call|exec\.Command|child_process\.exec)\s*\(",
        "Shell command execution — verify inputs are sanitized",
        "WARNING",
        (".go", ".py", ".js", ".ts", ".rb"),
        needs=("child_proce", "exec.command", "tem", "ubproce"),
    ),
    LineRule(
        "fallback-path-traversal",
        r"\.\./",
        "Path traversal pattern detected — verify input validation",
        "WARNING",
        needs=("../",),
    ),
    LineRule(
        "fallback-weak-hash",
        r"(?i)\b(md5|sha1)\s*[\.(]",
        "Weak hash function (MD5/SHA1) — use SHA-256 or stronger",
        "WARNING",
        (".go", ".py", ".js", ".ts", ".java", ".rb", ".php"),
        needs=("ha1", "md5"),
    ),
    LineRule(
        "fallback-debug-true",
        r"""(?i)(debug|DEBUG)\s*[:=]\s*(true|True|1|"true")""",
        "Debug mode enabled — ensure this is not deployed to production",
        "WARNING",
        needs=("debug",),
    ),
    LineRule(
        "fallback-cors-wildcard",
        r"""(?i)(access-control-allow-origin|cors.*origin)\s*[:=]\s*["']\*["']""",
        "CORS wildcard origin — allows any domain to make requests",
        "WARNING",
        needs=("-control-allow-origin", "origin"),
    ),
)

AGENT_RULES: tuple[AgentRule, ...] = (
    AgentRule(
        r"AKIA[0-9A-Z]{16}", "SECRETS", "CRITICAL", "CWE-798", "Hardcoded AWS access key", 0.80,
        needs=("AKIA",),
    ),
    AgentRule(
        r"-----BEGIN (RSA|EC|OPENSSH) PRIVATE KEY-----",
        "SECRETS", "CRITICAL", "CWE-321", "Private key embedded in source", 0.80,
        needs=(" PRIVATE KEY-----",),
    ),
    AgentRule(
        r'(?i)(query|sql)\s*:?=\s*"[^"]*"\s*\+',
        "INJECTION", "HIGH", "CWE-89", "SQL string concatenation detected", 0.75,
        needs=("ql", "query"),
    ),
    AgentRule(
        r"\beval\s*\(", "RCE", "HIGH", "CWE-95", "eval() call with possible user input", 0.75,
        needs=("eval",),
    ),
    AgentRule(
        r"""(?i)sslmode\s*=\s*["']?disable""",
        "INSECURE_CONFIG", "HIGH", "CWE-311", "TLS disabled on DB connection", 0.78,
        needs=("lmode",),
    ),
    AgentRule(
        r"""(?i)(password|passwd|pwd)\s*[:=]\s*["'][^"']{4,}["']""",
        "SECRETS", "HIGH", "CWE-259", "Hardcoded password in source", 0.72,
        needs=("wd", "word"),
    ),
    AgentRule(
        r"(?i)(md5|sha1)\s*\.new|hashlib\.(md5|sha1)",
        "CRYPTO_WEAK", "MEDIUM", "CWE-327", "Weak hashing algorithm used", 0.70,
        needs=(".new", "hlib."),
    ),
    AgentRule(
        r"Access-Control-Allow-Origin[^\n]*\*",
        "AUTH_BYPASS", "MEDIUM", "CWE-942", "CORS wildcard allows any origin", 0.70,
        needs=("Access-Control-Allow-Origin",),
    ),
    AgentRule(
        r"(?i)(DEBUG|debug)\s*[:=]\s*(true|True|1)\b",
        "INSECURE_CONFIG", "LOW", "CWE-489", "Debug mode enabled in code", 0.65,
        needs=("debug",),
    ),
    AgentRule(
        r"""(?i)(secret|api_key|apikey|token)\s*[:=]\s*["'][a-zA-Z0-9+/]{16,}["']""",
        "SECRETS", "HIGH", "CWE-798", "Hardcoded secret or token detected", 0.72,
        needs=("api_key", "apikey", "ecret", "token"),
    ),
)

BLOCKED_EXTENSIONS: tuple[str, ...] = (
    ".lock", ".sum", ".min.js", ".min.css",
    ".map", ".svg", ".png", ".jpg", ".jpeg",
    ".gif", ".ico", ".woff", ".woff2", ".ttf",
    ".eot", ".mp4", ".webm", ".pdf",
)

IMPORT_MARKS: dict[str, tuple[str, ...]] = {
    ".go": ("import",),
    ".js": ("require(", "from '", 'from "', "import "),
    ".ts": ("require(", "from '", 'from "', "import "),
    ".py": ("import ", "from "),
    ".rb": ("require ", "require_relative "),
    ".java": ("import ",),
    ".php": ("require ", "include ", "use "),
}

DECLARATION_MARKS: dict[str, tuple[str, ...]] = {
    ".go": ("func ", "type ", "interface "),
    ".js": ("function ", "const ", "class ", "export ", "module.exports"),
    ".ts": ("function ", "const ", "class ", "export ", "interface "),
    ".py": ("def ", "class ", "@"),
    ".rb": ("def ", "class ", "module "),
    ".java": ("public ", "private ", "protected ", "class ", "interface "),
    ".php": ("function ", "class ", "public ", "private "),
}

SIBLING_WORDS: tuple[str, ...] = (
    "middleware", "auth", "routes", "handler", "security", "permissions",
)

MAX_CONTEXT_FILES = 3
MAX_CONTEXT_LINES = 50
MAX_CONTEXT_BYTES = 8192

CONFIDENCE_FLOOR = 0.75
REGEX_AGENT = "regex-builtin"
GEMINI_AGENT = "gemini-2.0-flash"
OPENROUTER_AGENT = "openrouter-mistral-7b"
LOCAL_AGENT_PREFIX = "ollama-"
TEMPERATURE = 0.1
SNIPPET_BYTES = 120

# (provider, HTTP status) pairs with a message of their own; other statuses use the
# provider's general message, and 200 is success.
STATUS_ERRORS: tuple[tuple[str, int, str], ...] = (
    ("gemini", 403, "gemini: 403 forbidden (region block or bad key)"),
    ("gemini", 429, "gemini: 429 rate limited"),
    ("openrouter", 401, "openrouter: 401 unauthorized"),
    ("openrouter", 429, "openrouter: 429 rate limited"),
    ("openrouter", 503, "openrouter: 503 service unavailable"),
)
STATUS_OTHER: dict[str, str] = {
    "gemini": "gemini: unexpected status ",
    "openrouter": "openrouter: unexpected status ",
    "ollama": "ollama: status ",
}

SYSTEM_PROMPT = """You are an expert security auditor specializing in code vulnerability detection.
You will be given a git diff containing only ADDED lines (+) from a developer's staged commit.

STRICT RULES:
1. Analyze ONLY the added lines. Ignore removed lines entirely.
2. Only report findings with confidence >= 0.75.
3. Every finding MUST include a ready-to-apply fixed_line.
4. NEVER hallucinate line numbers. Only reference lines present in the input.
5. If no vulnerabilities exist, return {"findings": []}.
6. description max 100 chars. explanation max 150 chars.

SEVERITY (use exactly one): CRITICAL | HIGH | MEDIUM | LOW

VULN_CLASS (use exactly one): INJECTION | SECRETS | SSRF | RCE | AUTH_BYPASS |
CRYPTO_WEAK | PATH_TRAVERSAL | INSECURE_CONFIG | IDOR | XXE | OPEN_REDIRECT

RESPOND ONLY WITH RAW JSON. NO TEXT BEFORE OR AFTER. NO MARKDOWN FENCES.
VALID RESPONSE SHAPE:
{
  "findings": [{
    "id": "<sha256(file+line+class)[:8]>",
    "severity": "CRITICAL",
    "vuln_class": "INJECTION",
    "description": "User input concatenated into SQL query string",
    "line_number": 42,
    "code_snippet": "db.Query(\\"SELECT * FROM users WHERE id=\\" + userId)",
    "confidence": 0.97,
    "cwe": "CWE-89",
    "fix": {
      "fixed_line": "db.Query(\\"SELECT * FROM users WHERE id=?\\", userId)",
      "explanation": "Replace string concat with parameterized query",
      "automated": true
    }
  }]
}"""

TOP_RULES = 5
REPORT_DAYS = 30
PERIODIC_DAYS = 7
BAR_WIDTH = 20

# --- End of fixed values ------------------------------------------------------------

# Our own choice of text; pass another marker to the operators if a code base uses one.
SUPPRESS_MARKER = "scan-ignore"

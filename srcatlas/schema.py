"""Formats, enumerations and default texts that stored files depend on."""

from __future__ import annotations

# The annotation marker and the names under which results are stored.
MARKER = "@acp:"
CACHE_NAMES = ("acp.cache.json", "acp.vars.json")

# Whose word counts when documentation and annotations differ; the first is the default.
PRECEDENCES = ("acp-first", "native-first", "merge")

# Enumerations, spelled as they are stored.
LANGUAGES = (
    "typescript", "javascript", "python", "rust", "go", "java", "c-sharp", "cpp", "c", "ruby", "php", "swift", "kotlin",
)
LOCK_LEVELS = (
    "frozen", "restricted", "approval-required", "tests-required", "docs-required", "review-required", "normal", "experimental",
)
ORIGINS = ("explicit", "converted", "heuristic", "refined", "inferred")
SYMBOL_TYPES = ("function", "method", "class", "interface", "type", "enum", "struct", "trait", "const")
VARIABLE_TYPES = ("symbol", "file", "domain", "layer", "pattern", "context")
ATTEMPT_STATES = ("active", "testing", "failed", "verified", "reverted")
TOOLS = ("cursor", "claude-code", "copilot", "continue", "windsurf", "cline", "aider", "generic")

# File name extension to language.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyw": "python", "pyi": "python",
    "rs": "rust", "go": "go", "java": "java", "cs": "c-sharp",
    "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "hpp": "cpp", "hxx": "cpp",
    "c": "c", "h": "c", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin",
}

# Which files an index takes by default.
INCLUDE = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.rs", "**/*.py", "**/*.go", "**/*.java")
EXCLUDE = (
    "**/node_modules/**", "**/vendor/**", "**/dist/**", "**/build/**", "**/target/**", "**/out/**", "**/.next/**", "**/.nuxt/**",
    "**/.output/**", "**/.svelte-kit/**", "**/.vite/**", "**/.turbo/**", "**/.cache/**", "**/coverage/**", "**/__pycache__/**",
    "**/.pytest_cache/**", "**/.git/**", "**/.idea/**", "**/.vscode/**",
)

# Directives that an annotation has if it states none.
LOCK_DIRECTIVES = {
    "frozen": "MUST NOT modify this code under any circumstances",
    "restricted": "Explain proposed changes and wait for explicit approval",
    "approval-required": "Propose changes and request confirmation before applying",
    "tests-required": "All changes must include corresponding tests",
    "docs-required": "All changes must update documentation",
    "review-required": "Changes require code review before merging",
    "normal": "Safe to modify following project conventions",
    "experimental": "Experimental code - changes welcome but may be unstable",
}
DIRECTIVES = {
    "hack": "Temporary workaround - check expiry before modifying",
    "deprecated": "Do not use or extend - see replacement annotation",
    "todo": "Pending work item - address before release",
    "fixme": "Known issue requiring fix - prioritize resolution",
    "critical": "Critical section - changes require extra review",
    "perf": "Performance-sensitive code - benchmark any changes",
    "fn": "Function implementation",
    "function": "Function implementation",
    "class": "Class definition",
    "method": "Method implementation",
}

# Extensions that an import without one may stand for, in this order.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".rs", ".py", ".go")

# Thresholds.
REVIEW_BELOW = 0.8
LOW_CONFIDENCE = 0.5
EQUAL_WITHIN = 0.001
COVERAGE_GATE = 80.0
SYMBOL_WITHIN = 20

# Limits on what is read.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FILES = 100_000
MAX_ANNOTATIONS = 1_000
MAX_CONTENT_BYTES = 100_000

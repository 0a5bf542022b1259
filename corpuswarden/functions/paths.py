"""Path predicates and path arithmetic as SQL expressions."""

from __future__ import annotations

from corpuswarden.functions.text import quote

# Directories and suffixes that are never scanned.
IGNORED_DIRS = (
    "node_modules", ".git", ".next", ".nuxt", ".svelte-kit", "dist", "build", "out",
    "coverage", "venv", ".venv", "env", "__pycache__", ".pytest_cache", "target",
    "vendor", ".turbo", ".vercel", ".cache", "Pods", ".terraform",
)
IGNORED_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".pdf", ".zip", ".gz",
    ".tar", ".mp4", ".mov", ".mp3", ".woff", ".woff2", ".ttf", ".eot", ".lock", ".pyc",
    ".so", ".dylib", ".dll", ".wasm", ".map",
)
MINIFIED = (".min.js", ".min.css")

# What makes a path part of a test or fixture tree.
TEST_PATH = (
    r"(?i)(^|/)(tests?|__tests__|__mocks__|spec|specs|fixtures?|mocks?|examples?|samples?"
    r"|testdata)/"
    r"|(^|/)(test_[^/]+|[^/]+_test)\.py$"
    r"|\.(test|spec)\.[jt]sx?$"
    r"|(^|/)conftest\.py$"
)

# Suffix families and path markers the rules are scoped by.
DOC_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".ipynb", ".adoc")
JS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".svelte", ".vue", ".astro")
PY = (".py",)
CODE = JS + PY + (".go", ".rb", ".php", ".java", ".cs", ".rs")
CONFIG = (".json", ".yml", ".yaml", ".toml", ".env", ".ini", ".conf")
MODULES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py")
TEST_MARKERS = ("test", "spec", "__tests__", "fixtures", "mock", ".example")
SERVER_MARKERS = (
    "/api/", "route.ts", "route.js", "server", "actions", "handler", "views.py", "app.py",
)


def _literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in text)


def any_suffix(suffixes) -> str:
    return "(?:" + "|".join(_literal(s) for s in suffixes) + ")$"


def any_part(parts) -> str:
    return "|".join(_literal(p) for p in parts)


def has_suffix(rel: str, suffixes) -> str:
    return f"(lower({rel}) rlike {quote(any_suffix(suffixes))})"


def has_part(rel: str, parts) -> str:
    return f"(lower({rel}) rlike {quote(any_part(parts))})"


def is_ignored(rel: str) -> str:
    dirs = ", ".join(quote(d) for d in IGNORED_DIRS)
    return (f"(arrays_overlap(split({rel}, '/'), array({dirs})) "
            f"or {has_suffix(rel, IGNORED_SUFFIXES + MINIFIED)})")


def is_test(rel: str) -> str:
    return f"({rel} rlike {quote('(?U)' + TEST_PATH)})"


def basename(rel: str) -> str:
    return f"substring_index({rel}, '/', -1)"


def parent(rel: str) -> str:
    """The directory part, '.' at the top."""
    return f"if(contains({rel}, '/'), regexp_replace({rel}, '/[^/]*$', ''), '.')"


def stem(rel: str) -> str:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return f"regexp_replace({basename(rel)}, {quote(r'(?<=[^.])[.][^.]+$')}, '')"


def without_suffix(rel: str) -> str:
    """The whole path up to its last dot."""
    return f"regexp_replace({rel}, {quote(r'[.][^.]*$')}, '')"


def normalise(path: str) -> str:
    """Collapse '.', '..' and doubled slashes of a relative path."""
    step = (
        "(done, part) -> case when part in ('', '.') then done "
        "when part = '..' and size(done) > 0 and element_at(done, -1) <> '..' "
        "then slice(done, 1, size(done) - 1) "
        "else array_append(done, part) end"
    )
    joined = (f"array_join(aggregate(split({path}, '/'), cast(array() as array<string>), "
              f"{step}), '/')")
    return f"coalesce(nullif({joined}, ''), '.')"

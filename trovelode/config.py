"""Settings of the engine. The sets below are fixed values that decide which files belong to an index."""

from __future__ import annotations

import math
from dataclasses import dataclass

MAX_CHUNK_CHARS = 3500
MIN_CHUNK_CHARS = 100
MIN_CHUNK_REMAINDER_CHARS = 300
MERGE_MAX_CHUNK_CHARS = 400
MAX_CHARS_TOLERANCE_FACTOR = 1.15
#: 4,024 and not 4,025: the product is a little below 4,025 in binary floating point.
CHUNK_LIMIT = math.floor(MAX_CHUNK_CHARS * MAX_CHARS_TOLERANCE_FACTOR)
MAX_FILE_SIZE_BYTES = 1024 * 1024
FILES_PER_BATCH = 32
EMBEDDING_BATCH = 32
EMBEDDING_DIMENSIONS = 1536
DEFAULT_LIMIT = 20
DEFAULT_MIN_SCORE = 0.3
INDEX_DIRECTORY = ".trovelode"
RRF_K = 60
GREP_CONTEXT_LINES = 2
PREVIEW_LINES = 30
CONTENT_SCORE = 1.0
FILE_NAME_SCORE = 0.9
LIST_LIMIT_MAX = 1000
BM25_K1, BM25_B = 1.2, 0.75

#: Fixed values.
EXTENSIONS = [
    "ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "py", "rs", "go", "c", "h", "cpp", "hpp", "java", "kt",
    "rb", "php", "swift", "cs", "html", "css", "vue", "svelte", "json", "yaml", "yml", "toml", "md", "markdown", "sh",
    "bash", "zsh", "sql", "graphql", "lua", "zig", "scala", "ex", "exs", "vala", "vapi",
]
FILE_NAMES = ["Dockerfile", "Makefile", "Vagrantfile", "Gemfile", "Rakefile", ".env.example"]
IGNORED_DIRECTORIES = [
    "node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build", "out", "bundle", "vendor", "target",
    "tmp", "temp", ".next", ".nuxt", "coverage", "uploads", ".mcp-linux", ".cache", ".idea", ".vs", "eggs", ".eggs",
    "site-packages", ".tox", ".mypy_cache", ".ruff_cache", ".pytest_cache", "bower_components", ".gradle",
]
IGNORED_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "Gemfile.lock", "Cargo.lock", "poetry.lock",
    "Pipfile.lock", "go.sum", "flake.lock", "bun.lockb", ".DS_Store", "Thumbs.db",
]
STRUCTURED_EXTENSIONS = sorted({*EXTENSIONS, "htm"})
#: Other spellings of an extension, with the one under which its language is known.
ALIASES = {"mjs": "js", "cjs": "js", "mts": "ts", "cts": "ts", "bash": "sh", "zsh": "sh", "exs": "ex", "yml": "yaml"}


def overfetch(limit: int) -> int:
    """Rows that each channel gives to a fusion of ``limit`` rows."""
    return max(3 * limit, 50)


@dataclass(frozen=True)
class IndexConfig:
    """What an index is made with."""

    dimensions: int = EMBEDDING_DIMENSIONS
    embedding_batch: int = EMBEDDING_BATCH
    enabled: bool = True
    shared_directory: str | None = None

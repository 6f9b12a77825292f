"""Column expressions over file paths, identities and sources."""

from pyspark.sql import functions as F

# Paths left out, per language.
PYTHON_EXCLUDED = [
    r"test_.*\.py$", r".*/tests/.*\.py$", r".*/migrations/.*\.py$",
    r".*/vendor/.*\.py$", r".*/__pycache__/.*", r".*/setup\.py$",
]
JAVA_EXCLUDED = [
    r"Test\w+\.java$", r"\w+Tests?\.java$", r"\w+IT\.java$", r"\w+ITCase\.java$",
    r".*/generated(-sources)?/.*\.java$", r".*/protobuf/.*\.java$", r".*/target/.*\.java$",
    r".*/build/.*\.java$", r".*/test[s]?/.*\.java$", r"package-info\.java$", r"module-info\.java$",
]

# File extension to language.
EXTENSIONS = {
    ".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".md": "markdown", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".sh": "shell", ".bash": "shell",
}
BINARY_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".ico", ".svg",
    ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar", ".exe", ".dll", ".so",
    ".dylib", ".bin", ".mp4", ".mp3", ".wav", ".woff", ".woff2", ".ttf", ".eot",
]
NATIVE_IMPORTS = [r"\bimport\s+ctypes\b", r"\bfrom\s+cffi\b", r"\bimport\s+pyo3\b", r"\bimport\s+cython\b"]
IGNORED_FOLDERS = [".git", "__pycache__", "venv", ".venv", "build", "dist", "node_modules", "data", "models"]
MAX_SOURCE_BYTES = 512000


def slashes(path):
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_excluded(path, language="python"):
    """Whether a path is test, vendored or generated code; for Java also anything that is not .java."""
    clean = slashes(path)
    patterns = JAVA_EXCLUDED if language == "java" else PYTHON_EXCLUDED
    found = clean.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
    return (~clean.endswith(".java")) | found if language == "java" else found


def canonical_file_id(repo, path):
    return F.substring(F.md5(F.concat_ws("::", repo, slashes(path))), 1, 12)


def snapshot_id(repo, path, commit):
    return F.substring(F.sha2(F.concat_ws("::", repo, path, commit.cast("string")), 256), 1, 24)


def extension(path):
    """Lower-case suffix with its dot, empty without one; a leading dot of a name is no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))


def language_of(path):
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("plaintext"))


def file_class(path):
    """python, polyglot (a known extension), binary or plaintext."""
    ext = extension(path)
    return (
        F.when(ext == ".py", "python")
        .when(ext.isin(list(EXTENSIONS)), "polyglot")
        .when(ext.isin(BINARY_EXTENSIONS), "binary")
        .otherwise("plaintext")
    )


def fits_size(source, limit=MAX_SOURCE_BYTES):
    return (F.octet_length(source) > 0) & (F.octet_length(source) <= limit)


def native_import(source):
    return source.rlike("(?U)" + "|".join(NATIVE_IMPORTS))

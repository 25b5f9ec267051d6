"""Fixed schemas and fixed lookup values.

Everything that must equal the reference's behaviour for right results lives
here as plain data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------

# Extension -> category. An extension in none of these sets is "Others";
# an empty extension is "No extension".
CATEGORY_EXTENSIONS: dict[str, tuple[str, ...]] = {
    "Images": ("png", "jpg", "gif", "bmp", "webp", "jpeg"),
    "Documents": ("txt", "pdf", "doc", "docx", "ppt", "pptx"),
    "Audio": ("mp3", "wav", "aac"),
    "Video": ("mp4", "mkv", "avi", "mov"),
    "Archive": ("zip", "rar", "7z", "tar", "gz"),
    "Source Code": ("java", "py", "cpp", "c", "js", "html", "css", "go"),
}
OTHERS = "Others"
NO_EXTENSION = "No extension"

# Directory names (compared lowercased) whose whole subtree is left out of
# duplicate detection.
EXCLUDED_DIRECTORIES: tuple[str, ...] = (
    "windows", "program files", "program files (x86)", "programdata",
    ".git", "node_modules", "target", "bin",
)

# Directory names (compared lowercased) of the operating system's own, which a
# listing may leave out (``prune=SYSTEM_DIRECTORIES``).
SYSTEM_DIRECTORIES: tuple[str, ...] = ("$recycle.bin", "system volume information")

# Extensions treated as containers whose entries replace them.
ARCHIVE_EXTENSIONS: tuple[str, ...] = ("zip",)

# Bytes read for the quick hash.
QUICK_HASH_BYTES = 8192

# Separator between an archive's path and an entry name in a virtual path.
ARCHIVE_SEPARATOR = "!/"

# Number of rows in the default reports.
TOP_EXTENSIONS_K = 10
LARGEST_FILES_K = 5

# SHA-256 of zero bytes (the group every pair of empty files falls into).
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

KIND_FILE = "file"
KIND_DIR = "dir"
KIND_SKIPPED = "skipped"

INVENTORY_FIELDS = [
    T.StructField("kind", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("size", T.LongType(), True),
    T.StructField("extension", T.StringType(), True),
    T.StructField("from_archive", T.BooleanType(), True),
    T.StructField("archive_path", T.StringType(), True),
    T.StructField("mtime", T.TimestampType(), True),
    T.StructField("error", T.StringType(), True),
]
INVENTORY_SCHEMA = T.StructType(INVENTORY_FIELDS)
INVENTORY_COLUMNS = [f.name for f in INVENTORY_FIELDS]

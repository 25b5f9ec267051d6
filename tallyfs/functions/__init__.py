"""Column functions (extension, category, hidden, excluded, size text, hashes)."""

from tallyfs.functions.columns import (  # noqa: F401
    archive_of,
    category_of,
    extension_label,
    extension_of,
    hash_eligible,
    is_archive,
    is_excluded,
    is_hidden,
    leaf_name,
    parent_path,
    quick_sha256_hex,
    sha256_hex,
    size_text,
)

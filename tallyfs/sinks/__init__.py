"""Report sinks: one dataset per section, never overwriting an earlier scan."""

from tallyfs.sinks.reports import (  # noqa: F401
    new_scan_id,
    write_report,
    write_text_listing,
    write_text_summary,
)

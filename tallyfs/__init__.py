"""tallyfs — file-inventory analytics on Spark.

An inventory is a DataFrame with one row per file, folder or skipped item
(schema in :mod:`tallyfs.schema`). Every analysis is a plain DataFrame
transformation over it, so the same code runs on a tree listed from storage
and on an inventory derived from a table that holds content.

Main entry points::

    scan_tree(spark, root)                 list a tree, ZIPs replaced by entries
    table_inventory(df, path=, content=)   inventory from a table with content
    analyze(inventory, select_sections())  lazy report sections
    summary_rows(report)                   condensed (section, key, value) view
    find_duplicates(inventory)             the size -> 8 KB -> SHA-256 funnel
    write_outputs(report, sections, base)  text and CSV reports, never overwriting
"""

from tallyfs.operators.duplicates import find_duplicates  # noqa: F401
from tallyfs.plans.analyze import analyze, select_sections, summary_rows, write_outputs  # noqa: F401
from tallyfs.plans.scan import scan_tree  # noqa: F401
from tallyfs.schema import INVENTORY_SCHEMA  # noqa: F401
from tallyfs.sources.table import table_inventory  # noqa: F401

__all__ = ["INVENTORY_SCHEMA", "analyze", "find_duplicates", "scan_tree", "select_sections",
           "summary_rows", "table_inventory", "write_outputs"]

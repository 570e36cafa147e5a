"""All queries of this subpackage, and SQL for those it can express."""

from importlib import import_module

MODULES = ["components", "generated_files", "near_duplicates", "shared_spans", "syntax", "encoding_repair", "frequent_items", "packing", "contamination", "personal_data"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"keyloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

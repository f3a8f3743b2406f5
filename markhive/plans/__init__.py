"""End-to-end jobs that wire sources, operators and sinks."""

from .jobs import compare_files, convert_json, dedup_files, diff_files, parse_files

__all__ = ["compare_files", "convert_json", "dedup_files", "diff_files", "parse_files"]

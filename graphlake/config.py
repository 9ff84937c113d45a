"""Limits that change answers, with their defaults."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class Limits:
    max_files: int = 4000
    max_file_bytes: int = 400_000
    symbols: int = 6000
    hits_per_rule: int = 5
    lint_per_file: int = 10
    kept_issues: int = 200
    viz_files: int = 350
    fan_in_per_caller: int = 5
    depth: int = 3
    path_depth: int = 16
    cycles: int = 20
    search: int = 30
    find_hits: int = 200
    find_line: int = 240
    block_lines: int = 800
    doc_chars: int = 300
    signature_chars: int = 120


LIMITS = Limits()

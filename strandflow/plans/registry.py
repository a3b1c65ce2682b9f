"""Every query of the engine by name."""

from __future__ import annotations

from . import alignments, codes, formats, numbers, sequences, structures, tails

QUERIES: dict = {}
SQL: dict = {}
for _module in (sequences, formats, alignments, numbers, tails, structures, codes):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

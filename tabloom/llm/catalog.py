"""All queries of this subpackage."""

from tabloom.llm import decontamination, license_scan, lm_scoring, mixing, packing, periodic_runs, pii, quality_classifier, quality_rules, simhash, token_counts, warc, whitening  # noqa: F401
from tabloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

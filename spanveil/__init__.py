"""Finding and scrubbing personal data in Spark DataFrames, files and streams."""

import sys

from pyspark import cloudpickle

from .functions.catalog import ALL_TYPES, METHODS, PATTERN_TYPES, parse_method, parse_types, type_catalog
from .functions.registry import register
from .functions.spans import candidate_spans, find_spans
from .functions.splice import scrub_text, splice
from .operators.detect import as_text, detect, findings
from .operators.limits import LIMITED, UNLIMITED, Quota
from .operators.model import detect_with_model, predict
from .operators.scrub import scrub, scrub_marked, scrub_names
from .operators.stats import batch_totals, merge_profiles, profile, profile_sketches, save_profile, saved_profile, stats, type_counts
from .plans.file_run import FileScrub, scrub_files
from .streaming.scrub import running_type_counts, scrub_stream

# Functions that run in Python workers travel with their task, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ALL_TYPES", "METHODS", "PATTERN_TYPES", "LIMITED", "UNLIMITED", "FileScrub", "Quota",
    "as_text", "batch_totals", "candidate_spans", "detect", "detect_with_model", "find_spans", "findings",
    "merge_profiles", "parse_method", "parse_types", "predict", "profile", "profile_sketches", "register", "running_type_counts",
    "save_profile", "saved_profile", "scrub", "scrub_files", "scrub_marked", "scrub_names", "scrub_stream", "scrub_text", "splice", "stats", "type_catalog", "type_counts",
]

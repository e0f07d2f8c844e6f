"""Operations on training corpora. Nothing else in the library imports this subpackage."""

import sys
from importlib import import_module

from pyspark import cloudpickle

# Executors need no copy of the library: functions that run there travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = ("simhash_dedup", "secrets", "warc", "quality_crf", "decontaminate", "recompression", "quality_rules", "suffix_dedup", "licenses", "packing")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__name__}.{m}"), name).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")

"""Training-data operators: deduplication, classifiers, scans, formatting, media columns and packing.

Functions that run in Python workers travel by value, so that workers need no copy of this package.
"""

import importlib

from pyspark import cloudpickle

MODULES = ("common", "ogg", "packing", "licences", "chat", "windows", "jaccard", "textnet", "toxicity", "language", "lines", "leaks", "bpe", "periodic", "repair", "queries")
for _name in MODULES:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))

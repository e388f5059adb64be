"""corpusctx: build model prompts from very large text corpora with Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their code, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])

"""Document collections on Spark: ingest, enrich, search, cache analytics, compliance.

Every operator is a plain function from DataFrames (and parameters) to a DataFrame.
"""

import sys

from pyspark import cloudpickle

# Ship the package's Python task functions by value, so executors need no install step.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

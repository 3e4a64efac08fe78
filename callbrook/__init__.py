"""Knowledge-base ingestion, hybrid search and call intelligence as Spark jobs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Worker functions travel with the job, so executors need no installed copy.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

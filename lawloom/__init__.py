"""Document intelligence on Spark: cleaning, segmentation, versioning, retrieval and reporting as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Vectorised Python functions travel with their plan, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

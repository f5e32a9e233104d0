"""storyloom: documents, timelines, entities and embeddings as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions inside the task, so that they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

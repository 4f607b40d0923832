"""Array analytics on stacks of raster frames, and operators for training-data pipelines, as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: kernels travel to them inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

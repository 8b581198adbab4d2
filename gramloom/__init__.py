"""Association analytics on Spark: term scans, stepwise models, LASSO, ANOVA."""

import sys

from pyspark import cloudpickle

# Task functions of this package travel inside the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

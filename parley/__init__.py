"""parley: conversation-data jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to tasks carry their code along, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

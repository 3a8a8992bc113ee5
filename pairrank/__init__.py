"""Spark-native ranking of molecule-protein interactions.

Record files become keyed tables, tables become feature vectors, vectors and known
interactions become labelled matrices and models, and tables of queries are answered
with exact top-k rankings. Everything is a Spark plan; see README.md for the layout.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow functions travel to the executors inside the task, so a cluster needs no
# copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Statute segmentation, passage retrieval and conversation context as Spark jobs.

Every public operator takes DataFrames and returns DataFrames.  The few Python
kernels run inside ``mapInArrow`` / ``applyInArrow`` and are shipped by value, so
executors do not need this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

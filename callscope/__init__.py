"""callscope: Spark-native operators for ordered event sequences grouped by an id.

The guiding case is emergency-call triage: call records are scanned from nested
JSON, labelled by symptom rules, split, cut in time, assembled per call or per
prefix, turned into text features, scored, smoothed per call, reduced to first
hits and evaluated with exact classifier metrics.  Every operator is a lazy
``DataFrame -> DataFrame`` function (usable with ``DataFrame.transform``).
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors inside the tasks, so a
# cluster does not need the package on the workers' Python path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

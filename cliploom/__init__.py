"""cliploom - analytics over timed media tables, expressed as Spark DataFrame jobs.

Every public function takes and returns DataFrames.  Tables hold many videos; ``job_id`` names the
video, ``seq`` the position of a row inside it, and times are integer milliseconds.
"""

import sys

from pyspark import cloudpickle

# Python helpers travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

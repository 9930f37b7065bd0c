"""Training-data operators: de-duplication, scoring, packing, counting, archives and mixing.

Nothing outside this folder imports it.  Its functions travel to executors by value, so that
a cluster needs no copy of the package; what a worker wants to keep between tasks is held in
:func:`ringspark.llm.common.worker_cache`.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: formatting, filtering, deduplication, packing, sharding and byte-level BPE.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries and their SQL.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel as code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

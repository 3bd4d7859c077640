"""veilspark: media redaction expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"

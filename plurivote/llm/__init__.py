"""Operations of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

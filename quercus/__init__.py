"""Quality analytics for OWL ontologies and RDF graphs on Spark."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

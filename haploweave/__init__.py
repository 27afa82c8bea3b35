"""Read-evidence variation and phasing on Spark.

Importing the package registers it with PySpark's pickler so that functions
sent to Python workers travel with their code: executors need no copy of the
package on their own path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

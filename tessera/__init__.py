"""Tessera: a PySpark engine for measurements of segmented objects.

Tables are DataFrames, images are DataFrames of tiles.  Everything that can grow
with the data (a scene, a treatment group, one label) is split over tasks.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, so no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

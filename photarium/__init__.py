"""Media-library catalog and duplicate reports as Spark DataFrame operators.

The package keeps a library's history in append-only tables (files, observations,
metadata tags, hashes, run events) and derives everything else from them with
DataFrame transformations:

* ``sources``   - where rows come from: file listings, file bytes, decoded images
* ``functions`` - column expressions: paths, bits, tag text, units, error text
* ``operators`` - DataFrame -> DataFrame: latest state, work-lists, reports, ...
* ``plans``     - scan jobs built from the operators, and the run log
* ``streaming`` - incremental variants over the append-only logs
* ``catalog``   - the tables on storage and the calls a library user makes
"""

import sys

from pyspark import cloudpickle

from photarium.settings import ScanSettings

# Python tasks get this package's functions by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ScanSettings"]

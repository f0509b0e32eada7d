"""Training-data operators: decontamination, secrets, language, tokens,
toxicity, shards, page text, neighbours, licences and near duplicates.

Nothing else in the library imports this package.  Task code of the package
is shipped to the executors by value, so they need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

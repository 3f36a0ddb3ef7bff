"""Operators of a training-data pipeline over ``documents``, ``embeddings`` and ``conversations``.

One module per operator; :mod:`orgpulse.llm.queries` holds the registered queries and
:mod:`orgpulse.llm.oracle_sql` their DuckDB equivalents.  Nothing else in the library imports
this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so the executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

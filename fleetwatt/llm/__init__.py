"""Operators of a training-data pipeline over `documents` and `embeddings`.

Each module holds one operator: a general interface on DataFrames or columns, its parameters as named
constants, and the results of odd inputs in its docstring. `queries` derives the registered queries from them.
Task functions are pickled with their code, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

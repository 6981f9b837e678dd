"""Operators for building training corpora; nothing else in the library imports this folder."""

from pyspark import cloudpickle

import snapgrid

# Python workers need not have the package on their path.
cloudpickle.register_pickle_by_value(snapgrid)

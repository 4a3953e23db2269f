"""panelcast: time-series panels and forecast evaluation as Spark jobs.

Every public operator takes and returns a DataFrame. A *panel* has the columns
``series_id, slot, ts, y, y_filled, is_missing`` where ``slot`` is the number of
whole grid steps since 1970-01-01 UTC. Work is keyed by series, fold and
configuration, so many series, folds and settings run in one plan.
"""

import sys

from pyspark import cloudpickle

# Executors need not have the package: its few pandas functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Jobs over tables of files of many captured sites: extraction, resolution, crawl, deduplication, rewriting, packing, reports."""

import sys

from pyspark import cloudpickle

# The few Arrow helpers travel with their code, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

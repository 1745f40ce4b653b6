"""Training-data operators: quality, toxicity, personal data, secrets, URLs,
near-duplicates, source mixing and byte-level BPE.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to it.  Functions that run in Python workers are
pickled by value, so executors need the third-party libraries but not this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: quality, near-dedup, toxicity, packing, page text, BPE, scoring, fingerprints.

Nothing else in the library imports this subpackage; ``__spark_entry__``
adds its queries when it can be imported.  The helpers that run inside
Arrow batches are pickled by value, so executors need no copy of the
package on their path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""mailsift: mail classification as Spark jobs.

Raw messages (files, Maildir trees or streams) are parsed in Arrow batches,
normalised with native column expressions, turned into feature vectors,
fed to MLlib's logistic regression and scored / routed in batch or in
Structured Streaming with the same code path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle as _cloudpickle

# Python workers may start without this package on their sys.path (the
# driver process can be launched from anywhere), so functions defined here
# travel by value inside the task closures.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["__version__"]
__version__ = "0.1.0"

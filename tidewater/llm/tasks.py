"""Python functions of the operators, as Spark ships them to its workers.

The function that ``task`` returns is pickled by value and imports its operator's module on
the worker.  The folder of this package is offered there too, so a session whose workers
do not inherit the driver's module path (a notebook, a script started elsewhere) also runs;
on a cluster the package is installed on the executors.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark import cloudpickle

_HOME = str(Path(__file__).resolve().parents[2])


def task(factory: Callable, *args) -> Callable:
    """``factory(*args)``, made on the worker, as a function over Arrow batches."""
    home, module, name, packed = _HOME, factory.__module__, factory.__name__, pickle.dumps(args)

    def run(batches):
        import importlib
        import pickle
        import sys

        if home not in sys.path:
            sys.path.append(home)
        made = getattr(importlib.import_module(module), name)
        yield from made(*pickle.loads(packed))(batches)

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])

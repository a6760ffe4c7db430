"""Corpus operators for language-model training data (nothing else in tillroll imports them).

One module per operator, named after its method; ``queries`` registers them.  Text columns are read as
UTF-8 bytes; a *word* is a maximal run of bytes outside space and 0x09-0x0D, the same everywhere here.

Functions of this package travel to the executors inside the jobs that use them, so a cluster needs no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

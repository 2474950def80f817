"""Missing-data analytics on Spark."""

import os

# The driver's matrices are small: threads that wait for each other cost more than they bring.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

"""Column-level functions (JVM-side expressions only; no Python UDFs)."""
from callscope.functions.scalar import *  # noqa: F401,F403

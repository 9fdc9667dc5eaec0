"""fleetkit — fleet (tool / asset) analytics as Spark DataFrame operators.

Every operator is a function from DataFrames (plus an explicit ``as_of``
timestamp where dates matter) to a DataFrame.  Nothing is collected to the
driver; Catalyst / AQE choose the physical plan.
"""

from fleetkit.constants import AS_OF

__all__ = ["AS_OF"]

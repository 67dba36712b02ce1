"""tillbook: retail sales and inventory analytics as lazy Spark DataFrame operators.

Operators take a :class:`tillbook.sources.views.RetailTables` bundle plus keyword
parameters and return a lazy ``DataFrame``; nothing is collected to the driver.
"""

from tillbook.sources.views import RetailTables

__all__ = ["RetailTables"]

"""Spark-native KPI movement analytics.

Every public function takes and returns DataFrames; see the sub-packages:

* ``sources``   readers, writers and table upkeep
* ``functions`` column-level building blocks (exact sums, dates, text, series statistics)
* ``operators`` the analytical operators over fact tables and KPI tables
* ``plans``     the end-to-end movement report
* ``streaming`` append and latest-wins sinks for event rows
"""

from kpiloom.model import Kpi

__all__ = ["Kpi"]

"""framescope: dataset profiling and exploration as Spark DataFrame operators.

Modules:

* ``functions`` - canonical form (NaN -> null), column classes, naming;
* ``sources``   - CSV/Parquet/ORC/JSON loading, result sinks and payloads;
* ``operators`` - quality, statistics, exact quantiles, chart data,
  question operators, previews and findings;
* ``plans``     - chart plan, chart-on-request dispatch, end-to-end profile;
* ``streaming`` - nothing (the reference has no streams).
"""

from .plans.chart_data import ChartSpec, chart_data
from .plans.profile import Profile, profile

__all__ = ["ChartSpec", "Profile", "chart_data", "profile"]

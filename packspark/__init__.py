"""Battery-cycling analytics as lazy Spark DataFrame operators.

Main entry points (all ``DataFrame -> DataFrame``):

* sources: ``sources.cycles.read_cycles``, ``sources.files.read_data``, ``sources.logs.read_log``
* cleaning: ``operators.clean.rolling_outlier_replace``, ``segment_clean``, ``sigma_band_filter``
* energy: ``operators.energy.discharge_energy``, ``rpt_statistics``, ``rpt_gain``, ``gain_correlation``
* statistics: ``operators.ttest.welch_ttest``, ``operators.stats.mean_ci``, ``histogram``, ``density``,
  ``operators.median.group_median``
* voltages: ``operators.voltage.dcir_table``, ``cell_voltage_std``, ``polarization``, ``temperature_series``
* uncertainty: ``operators.uncertainty.capacity_bounds``, ``drop_outlier_cycles``,
  ``capacity_uncertainty``, ``time_uncertainty``, ``regime_breakdown``
* steps: ``operators.steps.charge_steps_state``, ``charge_steps_voltage``, ``step_reconcile``
* trends: ``operators.trend.fade_target_cycle``, ``extrapolation_segments``, ``energy_jump_removed``
* cohorts: ``operators.cohorts.cohort_delta``, ``recipe_clean_time``, ``recipe_pair_delta``
"""

import sys

from pyspark import cloudpickle

# Python stages travel to the executors by value, so these need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

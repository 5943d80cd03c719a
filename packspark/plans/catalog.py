"""All registered queries (importing the query modules fills the registry)."""

from packspark.plans import q_energy, q_misc, q_steps, q_uncertainty, q_voltage  # noqa: F401
from packspark.plans.registry import REGISTRY  # noqa: F401

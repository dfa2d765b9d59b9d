"""Panel preparation and panel causal inference on Spark DataFrames."""

from .operators.lasso import rigorous_lasso
from .operators.propensity import estimate_propensity
from .operators.unit_table import PanelError, UnitTable, unit_table, unit_tables
from .operators.weights import WeightError
from .plans.estimate import fit, interaction_effect, many_models, synthetic_did
from .spec import PanelSpec

__all__ = [
    "PanelError", "PanelSpec", "UnitTable", "WeightError", "estimate_propensity", "fit",
    "interaction_effect", "many_models", "rigorous_lasso", "synthetic_did", "unit_table",
    "unit_tables",
]

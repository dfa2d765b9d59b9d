"""Reading input files, writing results, and staging intermediate tables."""
from .files import (
    cast_key,
    read_csv,
    read_dimension,
    read_parquet,
    read_periods,
    read_year_folders,
    unique_dimension,
    write_periods,
    write_table,
)
from .stages import Stages, checked_small, driver_table, owned_by, stage, stage_observed

__all__ = [
    "Stages", "cast_key", "checked_small", "driver_table", "owned_by", "read_csv", "read_dimension", "read_parquet",
    "read_periods", "read_year_folders", "stage", "stage_observed", "unique_dimension", "write_periods", "write_table",
]

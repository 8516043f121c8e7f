"""cohortloom: Spark-native analytics for large entity-by-period panels.

Every operator is a plain function from DataFrames and column names to a
DataFrame (or, for fitted models, a small result object holding DataFrames).
"""

from cohortloom.roles import Roles
from cohortloom.session import build_session, materialise, scratch_path

__all__ = ["Roles", "build_session", "materialise", "scratch_path"]

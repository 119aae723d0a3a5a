"""faultline: set-wise diagnosis of failed data-pipeline tasks on Spark.

Every operator is a plain function from DataFrames to a DataFrame (``operators``), a builder of Columns
(``functions``), a reader or writer (``sources``), a streaming job (``streaming``) or a composition of those
(``plans``).  Nothing here runs on the driver except plan building.
"""

from faultline.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]

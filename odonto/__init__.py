"""odonto: clinic analytics and bulk operations on Spark.

Read models, reports, data-quality audits, set-level write jobs and change
feeds over a clinic's relational data (patients, dentists, appointments,
treatments, bills, payments, medicines, staff permissions, audit records),
expressed with the DataFrame API and Spark SQL.
"""

from odonto.session import build_session, ensure_checkpoint_dir
from odonto.sources.tables import Clinic

__all__ = ["build_session", "ensure_checkpoint_dir", "Clinic"]

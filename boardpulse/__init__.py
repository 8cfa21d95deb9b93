"""Product-usage analytics on Spark: sessions, reports, audit trail, entitlements, upkeep."""

from boardpulse.plans.params import ReportParams
from boardpulse.plans.report import UsageReport
from boardpulse.sources.tables import Tables

__all__ = ["ReportParams", "Tables", "UsageReport"]

"""The answers: usage report, audit log, entitlements."""

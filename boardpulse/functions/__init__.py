"""Scalar expressions shared by the plans."""

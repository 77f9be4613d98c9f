"""Catalog lineage analytics on Spark DataFrames."""

from threadline.session import build_session, scratch_dir, write_stage

__all__ = ["build_session", "scratch_dir", "write_stage"]

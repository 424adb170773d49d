"""Reports on physical plans: which star shape a query has, and why not another."""

from quillspark.plans.shapes import classify, metrics, shapes

__all__ = ["classify", "metrics", "shapes"]

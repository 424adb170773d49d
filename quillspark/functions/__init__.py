"""Column functions that Spark does not have in this form."""

from quillspark.functions.arithmetic import wrap32

__all__ = ["wrap32"]

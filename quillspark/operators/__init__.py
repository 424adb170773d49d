"""Star-schema operators as DataFrame compositions."""

from quillspark.operators.fused import fused_sum
from quillspark.operators.groupspace import GroupSpaceReport, decode, encode, report
from quillspark.operators.star import Agg, Dimension, Join, StarQuery, membership_count, star_aggregate, star_join

__all__ = ["Agg", "Dimension", "GroupSpaceReport", "Join", "StarQuery", "decode", "encode", "fused_sum", "membership_count", "report", "star_aggregate", "star_join"]

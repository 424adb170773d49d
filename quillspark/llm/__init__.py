"""Operators for training-data pipelines: de-duplication, filtering, search, packing and output.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers
``quillspark.llm.queries`` only where the subpackage can be imported.
"""

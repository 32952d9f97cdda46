"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; its queries and SQL are in
``delvestone.llm.queries``.
"""

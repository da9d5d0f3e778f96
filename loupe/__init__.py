"""loupe: review-topic analytics as Spark DataFrame jobs.

Every operator takes and returns Spark DataFrames. Column expressions live in
``loupe.functions``, DataFrame operators in ``loupe.operators``, readers and
writers in ``loupe.sources``, composed jobs and the registered query catalog
in ``loupe.plans``.
"""

from loupe.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

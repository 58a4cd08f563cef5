"""sigwin: direct-RNA signal-event analytics as Spark jobs.

Events aligned to transcript positions are collapsed into robust per-site
statistics, turned into seven-position context windows, labelled from a site
list or a reactivity profile, standardised, and scored by a two-model
ensemble.  Every step is a DataFrame transformation; see README.md.
"""

from sigwin.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]

from sigwin.sources import fixtures, profile, sinks, tsv

__all__ = ["fixtures", "profile", "sinks", "tsv"]

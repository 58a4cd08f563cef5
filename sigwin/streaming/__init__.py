from sigwin.streaming.scoring import score_stream, window_stream

__all__ = ["score_stream", "window_stream"]

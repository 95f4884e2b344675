from .hourly import drain, event_stream, score_hourly_stream, score_stream, stream_hourly

__all__ = ["drain", "event_stream", "score_hourly_stream", "score_stream", "stream_hourly"]

"""Resampling of streams: an extension, the same buckets with a watermark."""

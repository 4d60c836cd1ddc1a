from maieutic.streaming.live import live_averages, scored_batches

__all__ = ["live_averages", "scored_batches"]

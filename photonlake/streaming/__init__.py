"""streaming of the event-sensor engine."""

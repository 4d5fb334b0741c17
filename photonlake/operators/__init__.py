"""operators of the event-sensor engine."""

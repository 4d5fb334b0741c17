"""sources of the event-sensor engine."""

"""functions of the event-sensor engine."""

"""plans of the event-sensor engine."""

"""Collections and where they come from."""

"""Sources of the timeline engine."""

"""Plans of the timeline engine."""

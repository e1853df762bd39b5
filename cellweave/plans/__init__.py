"""From a configuration to results."""

"""Reading series, regions and grids."""

"""Column-level building blocks: measures and ratios, display formats, distributed positions."""

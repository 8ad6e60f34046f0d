"""Physical helpers: intermediate tables and prefix sums that no single task holds."""

"""Query catalog: every operator bound to the driver's tables, with its oracle SQL."""

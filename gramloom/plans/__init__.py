"""Programs: stepwise model building, LASSO, file conversion."""

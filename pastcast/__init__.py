"""Historical-analogue search, empirical forecasting and evaluation as Spark jobs."""

"""Jobs over archives of questionnaire trials, on Spark."""

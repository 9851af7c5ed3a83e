"""Query strategies, classifiers and regressors as DataFrame operators."""
